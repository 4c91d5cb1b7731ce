"""Source-code corpus preparation as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Executors need no installed copy: functions of this package travel with the tasks.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# isort: split
from repoweave.functions.imports import register_language
from repoweave.operators.dependencies import dependency_edges, extract_imports, resolve_imports
from repoweave.operators.graph import break_cycles, topo_levels
from repoweave.operators.ordering import order_files, shuffle_global, shuffle_in_repo
from repoweave.plans.corpus import corpus
from repoweave.plans.prepare import CorpusConfig, prepare
from repoweave.session import build_session
from repoweave.sources.tables import read_corpus
from repoweave.sources.tree import scan_repos

__all__ = [
    "CorpusConfig",
    "break_cycles",
    "build_session",
    "corpus",
    "dependency_edges",
    "extract_imports",
    "order_files",
    "prepare",
    "read_corpus",
    "register_language",
    "resolve_imports",
    "scan_repos",
    "shuffle_global",
    "shuffle_in_repo",
    "topo_levels",
]
