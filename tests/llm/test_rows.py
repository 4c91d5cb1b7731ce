"""Operators that judge each row: counts, scores, languages, secrets, quality, leaks, surrogates."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from repoweave.llm import crf, decontamination, language, ppm, quality, secrets, surrogates, token_counts
from repoweave.llm.queries import tokenizer_path
from repoweave.llm.words import flat_slices
from tests.llm import data

BPE = tokenizer_path("byte_bpe_50k.json")


def test_token_counts_are_those_of_the_library(spark):
    rng = random.Random(1)
    pool = "ab Z9é\n\t\r\x1c\x85\xa0 ᠎​'st'LL<|endoftext|>٣漢字\U0001f600́½ǅ_-.\x00\x0b"
    texts = ["".join(rng.choice(pool) for _ in range(rng.randrange(60))) for _ in range(3000)]
    texts += ["<|endoftext|>", "a<|endoftext|><|endoftext|> b", "it's I'LL"]
    counter = token_counts.PreTokenCounter(BPE, token_counts.whole_tokens(BPE))
    assert counter.count(texts) == token_counts._library_counts(BPE, texts)
    counter.known = {str(i): 1 for i in range(token_counts.KNOWN_STRINGS)}
    assert counter.count(texts) == token_counts._library_counts(BPE, texts)
    got = token_counts.token_counts(data.clashing(data.odd(spark)), BPE).collect()
    expected = [token_counts._library_counts(BPE, [r[1] or ""])[0] for r in data.odd_rows()]
    data.same(got, [(r[0], len((r[1] or "").encode()), n, n > 512) for r, n in zip(data.odd_rows(), expected, strict=True)])


def plain_scores(rows, learn):
    words, tables = Counter(), [defaultdict(Counter) for _ in range(5)]
    for (doc_id, text), yes in zip(rows, learn, strict=True):
        if yes:
            words.update([*data.WORD.findall(data.lower(text or "")), "\n"])
            symbols = [0] * 4 + list((text or "").encode()) + [256]
            for p in range(4, len(symbols)):
                for k in range(5):
                    tables[k][tuple(symbols[p - k : p])][symbols[p]] += 1

    def chance(context, symbol):
        total, excluded = 0.0, set()
        for k in range(4, -1, -1):
            table = tables[k].get(context[4 - k :])
            if not table:
                continue
            left = {s: n for s, n in table.items() if s not in excluded}
            if symbol in table:
                return total + math.log10(table[symbol] / (sum(left.values()) + len(left)))
            if left:
                total += math.log10(len(left) / (sum(left.values()) + len(left)))
            excluded = set(table)
        return total - math.log10(257 - len(excluded))

    n, v, out = sum(words.values()), len(words), []
    for doc_id, text in rows:
        tokens = [*data.WORD.findall(data.lower(text or "")), "\n"]
        symbols = [0] * 4 + list((text or "").encode()) + [256]
        score = sum(chance(tuple(symbols[p - 4 : p]), symbols[p]) for p in range(4, len(symbols)))
        base = sum(math.log10((words[t] + 0.1) / (n + 0.1 * (v + 1))) for t in tokens)
        out.append((doc_id, len(tokens), sum(words[t] > 0 for t in tokens), n, base, score))
    for context in ((0, 0, 0, 0), tuple(b"the "), tuple(b"qqqq")):
        assert math.isclose(sum(10 ** chance(context, s) for s in range(257)), 1.0, rel_tol=1e-9)
    return out


@pytest.mark.parametrize("blocks", [1, 4])
def test_partial_matching(spark, blocks):
    rows = [(r[0], r[1]) for r in data.odd_rows() if r[0] != 9]
    learn = [i is None or zlib.crc32(str(i).encode()) % 10 != 0 for i, _ in rows]
    df = data.clashing(spark.createDataFrame(rows, "doc_id long, text string"))
    block = F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks))
    key = lambda r: tuple((v is None, v) for v in r[:4])
    got = sorted(map(tuple, ppm.score_documents(df, ~ppm.held_out(), block).collect()), key=lambda r: (key(r), -r[4], -r[5]))
    expected = sorted(plain_scores(rows, learn), key=lambda r: (key(r), -r[4], -r[5]))
    for g, e in zip(got, expected, strict=True):
        assert g[:4] == e[:4]
        assert math.isclose(g[4], e[4], rel_tol=1e-9) and math.isclose(g[5], e[5], rel_tol=1e-5)


def test_partial_matching_without_training_or_rows(spark):
    df = spark.createDataFrame([(1, "ab")], "doc_id long, text string")
    row = ppm.score_documents(df, F.lit(False)).first()
    assert (row.n_tokens, row.n_known, row.train_tokens) == (2, 0, 0)
    assert math.isclose(row.score, -3 * math.log10(257), rel_tol=1e-6)
    assert ppm.score_documents(df.limit(0)).collect() == []


def test_partial_matching_with_blocks_that_change_between_reads(spark):
    rows = [(r[0], r[1]) for r in data.odd_rows() if r[0] != 9]
    df = spark.createDataFrame(rows, "doc_id long, text string")

    def tagged(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([time.time_ns()] * batch.num_rows)], names=["doc_id", "text", "at"])

    moving = df.mapInArrow(tagged, "doc_id long, text string, at long")
    key = lambda r: tuple((v is None, v) for v in r)
    got = sorted(map(tuple, ppm.score_documents(moving, block=F.col("at")).collect()), key=key)
    expected = sorted(map(tuple, ppm.score_documents(df).collect()), key=key)
    assert len(got) == len(expected)
    for g, e in zip(got, expected, strict=True):
        assert g[:4] == e[:4] and math.isclose(g[4], e[4], rel_tol=1e-9) and math.isclose(g[5], e[5], rel_tol=1e-5)


def test_lookup_raises_for_a_key_that_is_not_there():
    keys = np.arange(0, 3000, 3, dtype=np.uint64)
    found = ppm.Lookup(keys, keys.astype(np.float64))
    assert (found(keys) == keys).all() and len(found(keys[:0])) == 0
    for table, key in ((found, 4), (ppm.Lookup(keys[1:], keys[1:].astype(np.float64)), 0), (ppm.Lookup(keys[:0], np.zeros(0)), 7)):
        with pytest.raises(KeyError):
            table(np.array([key], dtype=np.uint64))


def test_languages_are_told_apart_on_held_out_rows(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language.identify(d).join(d.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_of_odd_rows_and_of_mixtures(spark):
    train = spark.createDataFrame([(data.PROSE, "en"), (data.OTHER, "de"), (None, "en"), ("x", None)], "text string, lang string")
    rows = {(r.doc_id, r.score > 0): r for r in language.languages(data.clashing(data.odd(spark)), train).collect()}
    assert rows[5, False].lang_pred == rows[6, False].lang_pred == rows[7, False].lang_pred == "und"
    assert rows[1, True].lang_pred == "en" and rows[4, True].lang_pred == rows[10, True].lang_pred == "de"
    digits = spark.createDataFrame([(1, "12 … ١٢ 3.4"), (2, data.PROSE * 2 + data.OTHER * 2)], "doc_id long, text string")
    digit, both = sorted(language.languages(digits, train).collect())
    assert (digit.lang_pred, digit.score) == ("und", 0.0)
    shares = dict((p.split(":")[0], float(p.split(":")[1])) for p in both.mixture.split(","))
    assert 0.3 < shares["en"] < 0.8 and 0.2 < shares["de"] < 0.7
    untaught = language.languages(digits, train.limit(0)).collect()
    assert [r.lang_pred for r in untaught] == ["und", "und"]
    assert language.languages(digits.limit(0), train).collect() == []


def test_viterbi_and_training_of_the_field():
    rng = np.random.default_rng(0)
    moves, first = rng.normal(size=(3, 3)), rng.normal(size=3)
    for _ in range(20):
        emit = rng.normal(size=(5, 3))
        best = max(
            np.ndindex(3, 3, 3, 3, 3),
            key=lambda s: first[s[0]] + sum(emit[t, s[t]] for t in range(5)) + sum(moves[s[t - 1], s[t]] for t in range(1, 5)),
        )
        assert tuple(crf.viterbi(emit, moves, first)) == best
    lines = [f'key{i} token = "{rng.bytes(20).hex()}" and the rest' for i in range(60)] + [data.PROSE[:150]] * 20
    model = crf.train([secrets._training_line(line) for line in lines])
    spans = secrets.field_spans([f"the new value is {rng.bytes(20).hex()} today", data.PROSE], model)
    assert spans[1] == []
    skipped = secrets.field_spans([line for line in lines[:10]], model)
    assert all(len(s) == 1 for s in skipped)


def test_lines_left_out_of_the_search_are_outside_anyway():
    rng = np.random.default_rng(4)
    lines = [f'token = "{rng.bytes(20).hex()}" x' for _ in range(30)] + [data.PROSE[:120]] * 10
    model = crf.train([secrets._training_line(line) for line in lines])
    tokens, _, _ = secrets._marks([*lines, data.OTHER, data.PROSE])
    begin, inside = model.scores(tokens, crf.B), model.scores(tokens, crf.I)
    emit = np.stack([np.zeros(len(begin)), begin, inside], axis=1)
    whole = np.concatenate([crf.viterbi(emit[tokens.line == k], model.moves, model.first) for k in np.unique(tokens.line)])
    assert (whole == crf.decode(model, tokens)).all()


def test_base_secrets_and_masks(spark):
    text = "é PassWord: \"abcdefgh\" token=short token: secret: abcdefghij AKIA1234567890AB AKIA12 " + "0af" * 11 + " api_key='x.y-z/+=9'"
    assert secrets.written(secrets.base_spans(text)) == (
        f"assign:2:21,access:{text.index('AKIA1')}:{text.index('AKIA1') + 16},hex:{text.index('0af')}:{text.index('0af') + 33},"
        f"assign:{text.index('api_key')}:{len(text) - 1}"
    )
    df = data.clashing(data.odd(spark).union(spark.createDataFrame([(50, text, "en", "a", 1)] * 2, data.SCHEMA)))
    rows = secrets.scan_secrets(df, with_text=True).collect()
    assert len(rows) == len(data.odd_rows()) + 2
    hit = [r for r in rows if r.doc_id == 50]
    assert hit[0] == hit[1] and (hit[0].n_assign, hit[0].n_access, hit[0].n_hex) == (2, 1, 1)
    assert "abcdefgh\"" not in hit[0].masked and hit[0].masked.count("[SECRET]") >= 4
    assert all(r.spans == "" for r in rows if r.doc_id in (None, 1, 5, 6, 7))
    masked = secrets.mask_secrets(df)
    assert masked.columns == df.columns and masked.count() == df.count()
    assert masked.filter("doc_id = 50").first().n_chars == len(hit[0].masked)
    clean = {r.doc_id: r.text for r in masked.collect()}
    assert clean[1] == data.PROSE and clean[5] is None
    assert secrets.scan_secrets(data.odd(spark).limit(0)).collect() == []


def test_stretches_of_field_spans_beyond_base_spans_are_kept():
    text = "password = abcdefgh12üxyz end"
    base = secrets.base_spans(text)
    assert [(a, b) for a, _, b in base] == [(0, text.index("ü"))]
    start = text.index("abc")
    spans = secrets.merged_spans(base, [(start, 3, text.index(" end"))])
    assert spans == [*base, (text.index("ü"), 3, text.index(" end"))]
    assert "xyz" not in secrets.masked(text, spans) and secrets.masked(text, spans).endswith(" end")
    rng = random.Random(3)
    for _ in range(500):
        base = [(a, 0, a + rng.randrange(1, 8)) for a in rng.sample(range(40), rng.randrange(4))]
        more = [(a, 3, a + rng.randrange(1, 20)) for a in (0, 22) if rng.random() < 0.7]
        got = secrets.merged_spans(sorted(base), more)
        inside = lambda spans: {i for a, _, b in spans for i in range(a, b)}
        extra = [s for s in got if s[1] == 3]
        assert got == sorted(got) and [s for s in got if s[1] == 0] == sorted(base)
        assert inside(extra) == inside(more) - inside(base) and sum(b - a for a, _, b in extra) == len(inside(extra))


def test_quality_counts_and_rules(spark):
    df = data.clashing(data.odd(spark))
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality.quality(df, none)
    expected = []
    for r in data.odd_rows():
        counts = data.quality_counts(r[1])
        failed = counts[0] < 50 or 100 * counts[4] > 50 * counts[0]
        expected.append((r[0], *counts, failed, not failed, 0))
    data.same(got.collect(), expected)
    assert quality.quality(df.limit(0), none).collect() == []
    kept = quality.keep_good(df, none)
    assert kept.columns == df.columns
    data.same([(r.doc_id, r.text) for r in kept.collect()], [(r[0], r[1]) for r, e in zip(data.odd_rows(), expected, strict=True) if e[7]])


def test_decision_list_is_learned_and_agrees_with_its_expression(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    found = quality.fit(d, labels)
    assert found.rules
    rows = quality.document_counts(d, found.flagged).select(
        "k0", quality.verdict(found.rules).alias("rule"), *[e.alias(f"s_{n}") for n, e in quality.statistics().items()]
    ).collect()
    for r in rows:
        x = np.array([[r[f"s_{n}"] for n in quality.STATISTICS]])
        first = next((i for i, rule in enumerate(found.rules, 1) if quality._covers(rule, x)[0]), 0)
        assert r.rule == first
    good = {r.doc_id for r in labels.filter("quality = 1 and toxic = 0").collect()}
    poor = {r.doc_id for r in labels.filter("quality = 0").collect()}
    verdicts = {r.k0: r.rule for r in rows}
    assert sum(verdicts[i] > 0 for i in good if i in verdicts) <= 0.02 * len(good)
    assert sum(verdicts[i] > 0 for i in poor if i in verdicts) >= 0.4 * len(poor)


def test_wand_retrieves_exactly_what_reaches_the_threshold():
    rng = random.Random(0)
    items = [(i, " ".join(f"w{int(rng.expovariate(0.02))}" for _ in range(rng.randrange(1, 130)))) for i in range(150)]
    index = decontamination.Index(items)
    for _ in range(300):
        query = sorted(rng.sample(range(len(index.terms)), rng.randrange(1, 60)))
        threshold = rng.choice([0.02, 0.05, 0.1, 0.2, 0.5])
        score = np.zeros(len(index.owner))
        for t in query:
            score[index.chunk[index.starts[t] : index.starts[t + 1]]] += index.impact[index.starts[t] : index.starts[t + 1]]
        assert {c for c, _ in index.search(query, threshold)} == set(np.flatnonzero(score >= threshold - 1e-9).tolist())


def test_leaks_in_whole_and_in_part(spark):
    rng = random.Random(2)
    say = lambda n: " ".join(f"q{rng.randrange(5000)}" for _ in range(n))
    items = [(i, f"{say(20)}. {say(12)}.") for i in range(30)] + [(30, say(200)), (31, "one"), (32, ""), (33, None), (None, say(30))]
    clean = [(i, say(150)) for i in range(40)]
    leaked = [(100 + i, f"{say(60)} {items[i][1].upper()} {say(60)}") for i in range(30)] + [(130, say(90) + " " + items[30][1])]
    leaked += [(140, items[3][1]), (140, items[3][1])]
    docs = data.clashing(spark.createDataFrame([*clean, *leaked, (None, items[5][1]), (7, None), (8, "")], "doc_id long, text string"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    for shard in (decontamination.SHARD_ITEMS, 7):
        got = decontamination.find_leaks(docs, bench, shard_items=shard)
        expected = [(100 + i, i) for i in range(31)] + [(140, 3)] * 2 + [(None, 5)]
        data.same([(r.doc_id, r.item_id) for r in got.collect()], expected)
        kept = decontamination.without_leaks(docs, bench, shard_items=shard)
        assert kept.columns == docs.columns and kept.count() == 42
    assert decontamination.find_leaks(docs, bench.limit(0)).collect() == []
    assert decontamination.without_leaks(docs.limit(0), bench).collect() == []


def test_surrogates_are_consistent_distinct_and_of_the_same_kind(spark):
    text = (
        "Call Anna Kowalski at anna.k@Mail.example.org, 743-555-3824 / +1 (743) 555-3824; card 4111 1111 1111 1111 and "
        "4111111111111111; DE89 3704 0044 0532 0130 00; 10.1.2.3; 123-45-6789; Иван Петров."
    )
    more = [(60, text, "en", "a", 1), (61, text.lower(), "en", "a", 1), (None, text, None, None, None)]
    df = data.clashing(data.odd(spark).union(spark.createDataFrame(more, data.SCHEMA)))
    rows = surrogates.pseudonymize(df).collect()
    source = [(r[0], r[1]) for r in [*data.odd_rows(), *more]]
    assert len(rows) == len(source)
    plain = [(i, t) for i, t in source if not surrogates.entities(t or "")]
    data.same([(r.doc_id, r.text) for r in rows if r.n_entities == 0], plain)
    new = next(r.text for r in rows if r.doc_id == 60)
    old, now = surrogates.entities(text), surrogates.entities(new)
    assert [e[2] for e in old] == [e[2] for e in now]
    assert len({(e[2], e[3]) for e in old}) == len({(e[2], e[3]) for e in now})
    assert not {e[3] for e in old} & {e[3] for e in now}
    by_kind = {e[2]: e for e in now}
    assert surrogates.luhn(by_kind["card"][3]) == 0 and surrogates._account_rest(by_kind["account"][3]) == 1
    assert by_kind["address"][3].startswith("10.") and re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}", new)
    assert new.split("Call ")[1].split(" ")[0] in surrogates.NAMES["latin", "f"]
    assert by_kind["name"][3].split(" ")[0].capitalize() in surrogates.NAMES["cyrillic", "m"]
    other = surrogates.pseudonymize(df, b"another key").filter("doc_id = 60").first().text
    assert other != new
    assert surrogates.pseudonymize(df.limit(0)).collect() == []


def test_no_text_with_an_entity_is_passed_over():
    names = surrogates._name_hashes()
    last = {"latin": "Kowalski", "cyrillic": "Петрова", "greek": "Παππά"}
    texts = []
    for first, (script, _) in surrogates._OF_NAME.items():
        person = f"{first} {last[script]}"
        texts += [f"{a}{person}{b}" for a, b in ("“”", "«»", "—,", "‘’", "…\xa0", "\xa0.", "、。", "¡!", ("", ""), ("x \U0001f600", "-"))]
        texts += [f"я{person}", f"é{person}", f"a{person}", f"{first}\xa0{last[script]}", first, f"{first} ", f"{first}"]
    texts += ["AB12ABCDEFGH", "x AB12 ABCD EFGH IJ", "AB12", "aAB12ABCDEFGH", "1.2.3.4", "+12345", "a@b.cd", "a@b", "", "é", "AB1", "12"]
    rng = random.Random(6)
    pool = ["Anna", "Иван", " ", " Xy", "“", "\xa0", "—", "é", "я", "1", "AB", "12", "ABCD", "EFGH", "_", "@", "́"]
    texts += ["".join(rng.choice(pool) for _ in range(rng.randrange(9))) for _ in range(20_000)]
    wanted = np.array([surrogates.PATTERN.search(t) is not None for t in texts])
    for limit in (1, 100, 1 << 19):
        marks = np.concatenate([surrogates.suspects(f, names) for _, _, f in flat_slices(pa.array(texts), limit)])
        assert len(marks) == len(texts) and not (wanted & ~marks).any()
    assert not marks[-20_000:].all() and wanted[-20_000:].any()


def test_surrogates_of_names_between_signs(spark):
    texts = ["“Anna Kowalski” said so", "it was—Anna Kowalski", "«Анна Петрова»", "a\xa0Anna Kowalski", "Anna Kowalski", "IT60 ABCD EFGH"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = [r for r in sorted(surrogates.pseudonymize(df).collect())]
    assert [r.n_entities for r in rows] == [1] * len(texts)
    assert not [r.text for r in rows if "Kowalski" in r.text or "Петрова" in r.text or "ABCD" in r.text]
    assert rows[0].text == f"“{rows[4].text}” said so"


def test_counts_of_surrogates_are_those_of_one_text(spark):
    twice, once = "a@b.example, c@d.example, a@b.example; 123-45-6789", "x Anna Kowalski"
    df = spark.createDataFrame([(1, twice)] * 50 + [(2, once)] * 30 + [(3, None)], "doc_id long, text string").coalesce(1)
    got = Counter((r.doc_id, r.n_mail, r.n_social, r.n_name, r.n_entities) for r in surrogates.pseudonymize(df).collect())
    assert got == {(1, 3, 1, 0, 4): 50, (2, 0, 0, 1, 1): 30, (3, 0, 0, 0, 0): 1}


def test_clashing_surrogates_are_drawn_again(spark, monkeypatch):
    rows = [("address", f"1.1.1.{i}") for i in range(40)] + [("mail", "1.1.1.1")]
    df = spark.createDataFrame(rows, "kind string, entity string")

    def narrow(key, kind, entity, attempt):
        return f"1.1.1.{surrogates.Draw(key, kind, entity, attempt).below(30 * (attempt + 1))}"

    monkeypatch.setattr(surrogates, "surrogate", narrow)
    got = surrogates.assign(df).collect()
    assert {(r.kind, r.entity) for r in got} == set(rows)
    assert len({(r.kind, r.surrogate) for r in got}) == len(rows)
    assert not {(r.kind, r.surrogate) for r in got} & set(rows)


def test_crowded_formats_get_wider_surrogates(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = [("mail", f"{a}@{b}.com") for a in letters for b in letters] + [("mail", "-@-.com")]
    rows += [("address", f"192.168.{i >> 8}.{i & 255}") for i in range(1 << 16)]
    got = surrogates.assign(spark.createDataFrame(rows, "kind string, entity string")).collect()
    assert len(got) == len(rows) and {(r.kind, r.entity) for r in got} == set(rows)
    assert len({(r.kind, r.surrogate) for r in got}) == len(rows)
    assert not {(r.kind, r.surrogate) for r in got} & set(rows)
    assert all(r.surrogate.startswith("10.") for r in got if r.kind == "address")


def test_wider_surrogates_keep_kind_and_signs():
    values = [
        ("mail", "a@b.com"), ("phone", "+12345"), ("phone", "743-555-3824"), ("phone", "(743) 555-3824"), ("phone", "+1 (743) 555-3824"),
        ("card", "4111 1111 1111 1111"), ("card", "4111111111111"), ("account", "DE89 3704 0044 0532 0130 00"), ("name", "Anna Kowalski"),
    ]
    for kind, value in values:
        entity = surrogates.canonical(kind, value)
        drawn = [surrogates.surrogate(b"k", kind, entity, attempt) for attempt in range(12)]
        for new in drawn:
            shown = surrogates.rendered(kind, value, new)
            assert [(e[2], e[3]) for e in surrogates.entities(shown)] == [(kind, new)], (value, shown)
        assert len(drawn[0]) < len(drawn[11]) or kind == "name"
    for kind, value in [("social", "123-45-6789"), *values]:
        new = surrogates.surrogate(b"k", kind, surrogates.canonical(kind, value), 80)
        shown = surrogates.rendered(kind, value, new)
        assert surrogates.canonical(kind, shown) == new
    assert surrogates.luhn(surrogates.surrogate(b"k", "card", "4111111111111111", 9)) == 0
    for entity in ("192.168.0.1", "10.1.2.3", "8.8.8.8", "127.0.0.1"):
        last = {surrogates.surrogate(b"k", "address", entity, 24 + i) for i in range(1000)}
        assert len(last) == 1000 and all(v.startswith("2001:db8:" if entity == "8.8.8.8" else "fd") for v in last)


def test_slices_never_cut_a_text():
    texts = pa.array(["", None, "aé", "x" * 100, "b"]).slice(1)
    pieces = [(lo, hi, bytes(f.data), f.offsets.tolist()) for lo, hi, f in flat_slices(texts, 4)]
    assert b"".join(p[2] for p in pieces) == ("aé" + "x" * 100 + "b").encode()
    assert [p[:2] for p in pieces] == [(0, 2), (2, 3), (3, 4)]


def planted(draw):
    """Secrets that no base pattern matches, in the forms in which they are met."""
    key = lambda n: "".join(draw.choices(secrets.ALNUM, k=n))
    return [
        ("client_key: ", key(24)), ("", "sk_live_" + key(24)), ("", "ghp_" + key(36)), ("Authorization: Bearer ", key(40)),
        ("pwd=", draw.choice(["Tr0ub4dor3x", "Hunter2Winter19", "s3cretPass99"])), ('private_key = "', key(32)), ("credentials: ", key(20)),
    ]


def test_the_field_finds_planted_secrets_and_leaves_clean_texts_alone(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    known = {r.doc_id: r.text or "" for r in docs.collect()}
    clean = [i for i, t in known.items() if t and not secrets.base_spans(t)]
    draw, rows, places = random.Random(7), [], {}
    for k, doc_id in enumerate(clean[:210]):
        before, value = planted(draw)[k % 7]
        cut = draw.choice([m.end() for m in re.finditer(r"\s", known[doc_id])])
        start = cut + len(before)
        places[10**9 + k] = (start, start + len(value))
        rows.append((10**9 + k, f"{known[doc_id][:cut]}{before}{value} {known[doc_id][cut:]}"))
    every = docs.union(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r.doc_id: r for r in secrets.scan_secrets(every).collect()}
    spans = {i: [tuple(map(int, s.split(":")[1:])) for s in r.spans.split(",") if s] for i, r in got.items()}
    found = [any(a <= start and end <= b for a, b in spans[i]) for i, (start, end) in places.items()]
    assert sum(found) >= 0.9 * len(places)
    assert sum(got[i].n_crf > 0 for i in clean) <= 0.001 * len(known)
    for i, text in known.items():
        base = secrets.base_spans(text)
        assert set(secrets.written(base).split(",")) <= set(got[i].spans.split(","))


def test_base_columns_of_a_whole_table_are_those_of_a_plain_scan(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    patterns = {
        "assign": r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        "access": r"AKIA[A-Z0-9]+", "hex": r"[0-9a-f]+",
    }
    known = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in secrets.scan_secrets(docs).collect():
        spans = []
        for k, (kind, pattern) in enumerate(patterns.items()):
            for m in re.finditer(pattern, known[r.doc_id]):
                if len(m[2] if kind == "assign" else m[0]) >= (8, 16, 32)[k]:
                    spans.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
        counts = Counter(k for _, k, _ in spans)
        assert (r.n_assign, r.n_access, r.n_hex) == (counts[0], counts[1], counts[2])
        assert r.base_sha256 == hashlib.sha256(",".join(s for *_, s in sorted(spans)).encode()).hexdigest()


def test_training_windows_reach_the_whole_text():
    text = ("plain words here " * 200 + "\n") * 3 + "x " * 300 + "token = " + "ab12" * 10 + " tail " * 100
    places = list(secrets._places(text))
    assert [text[a:b] for a, b, positive in places if positive][0].startswith("token")
    start, end, _ = next(p for p in places if p[2])
    window = secrets._window(text, start, end)
    assert "ab12" * 10 in window and len(window) <= end - start + 2 * secrets.AROUND
    _, states = secrets._training_line(window)
    assert (states == crf.B).sum() == 1 and len(states) <= crf.LINE_TOKENS
    assert secrets._window("word", 2, 2) == "word" and list(secrets._places("a")) == [(0, 0, False)]


def plain_leaks(docs, items):
    """All leaks by scoring every passage against every chunk, with words and pairs spelled out."""
    words = lambda text: re.findall(r"[0-9a-z\u0080-\U0010ffff]+", data.lower(text))
    pairs = lambda w: list(zip(w, w[1:], strict=False)) or [(v,) for v in w]
    size = decontamination.CHUNK_TERMS
    chunks, sides = [], {}
    for item_id, text in items:
        own = words(text or "")
        if not own:
            continue
        cut = [m.end() for m in re.finditer(r"[.?!\n]+\s+(?=\S)", text.strip())]
        first = words(text.strip()[: cut[-1]]) if cut else own
        sides[item_id] = pairs(first), pairs(own[len(first) - 1 :]) if len(first) < len(own) else pairs(own)
        for part in np.array_split(np.array(own, dtype=object), math.ceil(len(own) / size)):
            chunks.append((item_id, pairs(part.tolist())))
    df = Counter(p for _, c in chunks for p in set(c))
    mean = sum(len(c) for _, c in chunks) / len(chunks)
    weight = lambda p: math.log(1 + (len(chunks) - df[p] + 0.5) / (df[p] + 0.5))
    share = lambda wanted, known: sum(p in known for p in wanted) / len(wanted)
    out = []
    for doc_id, text in docs:
        own = words(text or "")
        best, part, near = defaultdict(float), defaultdict(float), defaultdict(set)
        for k in range(max(1, math.ceil(len(own) / size) - 1) if own else 0):
            passage = set(pairs(own[k * size : (k + 2) * size])) if len(own) > 1 else {(own[0],)}
            region = own[max(0, (k - 1) * size) : min((k + 2) * size, len(own)) + size]
            region = set(zip(region, region[1:], strict=False)) | {(w,) for w in region}
            for item_id, chunk in chunks:
                norm = decontamination.K1 * (1 - decontamination.B + decontamination.B * len(chunk) / mean)
                impact = {p: weight(p) * tf / (tf + norm) for p, tf in Counter(chunk).items()}
                score = sum(v for p, v in impact.items() if p in passage) / sum(impact.values())
                if score >= decontamination.THRESHOLD - 1e-9:
                    best[item_id] = max(best[item_id], score)
                    part[item_id] = max(part[item_id], share(chunk, region))
                    near[item_id] |= region
        for item_id, score in best.items():
            question, answer = (share(side, near[item_id]) for side in sides[item_id])
            if question >= 0.7 or (question >= 0.5 and answer >= 0.5) or part[item_id] >= 0.8:
                out.append((doc_id, item_id, round(score, 9), round(question, 9), round(answer, 9), round(part[item_id], 9)))
    return out


def test_leaks_of_stretches_and_edited_items_equal_brute_force(spark):
    rng = random.Random(5)
    say = lambda n: [f"q{rng.randrange(300)}" for _ in range(n)]
    items = [(i, " ".join(say(20)) + ". " + " ".join(say(rng.randrange(1, 14))) + ".") for i in range(25)]
    items += [(25 + i, " ".join(say(200))) for i in range(5)] + [(30, "Who? " + " ".join(say(9))), (31, "one"), (32, " \n"), (33, None)]
    docs = [(i, " ".join(say(rng.randrange(1, 260)))) for i in range(20)] + [(20, None), (21, ""), (22, "one"), (23, "One. two")]
    for i, (_, text) in enumerate(items[:31]):
        own = text.split(" ")
        if i < 25:
            for changed in (2, 5, 9):  # two changed words are still a leak
                new = own.copy()
                for at in rng.sample(range(len(own)), changed):
                    new[at] = "changed"
                docs.append((100 * changed + i, " ".join([*say(70), *new, *say(130)])))
        else:
            start = rng.randrange(max(1, len(own) - 90))
            docs.append((2000 + i, " ".join([*say(61), *own[start : start + 90], *say(77)])))
    expected = plain_leaks(docs, items)
    assert {(2000 + i, i) for i in range(25, 31)} <= {r[:2] for r in expected}
    assert sum((200 + i, i) in {r[:2] for r in expected} for i in range(25)) >= 24
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    whole = [tuple(r) for r in decontamination.find_leaks(frame, bench).collect()]
    data.same([(*r[:2], *(round(v, 9) for v in r[2:])) for r in whole], expected)
    for options in ({"shard_items": 6}, {"shard_bytes": 1500}):
        data.same([tuple(r) for r in decontamination.find_leaks(frame, bench, **options).collect()], whole)
    assert decontamination.without_leaks(frame, bench, shard_items=9).count() == len(docs) - len({r[0] for r in whole})
