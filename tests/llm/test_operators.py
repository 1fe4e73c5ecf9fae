import zlib
from fractions import Fraction

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessella.llm import bpe, classifier, near, packing, pii, quality_rules, queries, secrets, substring, topk
from tessella.llm.token_store import MAX_BITS, Codebook, TokenStore, code_lengths
from tessella.llm.tokens import BYTE_FILE, WORD_FILE, WordIds
from tests.llm import fixture as fx

WORD_PATH, BYTE_PATH = public_tokenizers.path(WORD_FILE), public_tokenizers.path(BYTE_FILE)
AWKWARD = st.text(st.sampled_from(list(" \n\tab'sÉéİΣ.,12<|>  ́日\r\x1c🎉delve")), max_size=60)


@pytest.fixture(scope="module")
def docs(spark):
    return fx.documents(spark).repartition(3).cache()


@pytest.mark.parametrize("path", [WORD_PATH, BYTE_PATH])
def test_cached_words_give_the_ids_of_the_whole_text(path):
    cached, whole = WordIds(path), Tokenizer.from_file(path)

    @settings(max_examples=400, deadline=None)
    @given(AWKWARD)
    def same(text):
        assert np.frombuffer(cached.ids(text.encode()), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids

    same()
    for text in ("a<|endoftext|> b", "  <|startoftext|>", "don't WE'LL"):
        assert np.frombuffer(cached.ids(text.encode()), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("path", [WORD_PATH, BYTE_PATH])
def test_columns_of_texts_give_the_ids_of_whole_texts(path):
    cached, whole = WordIds(path), Tokenizer.from_file(path)

    def check(texts, skip):
        got = cached.column(pa.array(texts, pa.string()).slice(skip), b"\2\0\0\0").to_pylist()
        assert [np.frombuffer(x, "<u4").tolist() for x in got] == [[*whole.encode(t or "", add_special_tokens=False).ids, 2] for t in texts[skip:]]

    settings(max_examples=200, deadline=None)(given(st.lists(st.one_of(st.none(), AWKWARD), min_size=1, max_size=6), st.integers(0, 2))(check))()
    odd = ["Dog's. dog's, x'. 'S.'s a-'. ...", "× a×. ÷, é×! —, a—. ½. 12.5, (3)", "I\u0307. İ. ſ. e\u0301. e\u0301a, ÉTÉ. ŉ! =\u0338 a=\u0338.", "слово. СЛОВО, 字。 a\x1cb. \ufeffa.", None, "", " \t\n", "x" * 200 + "."]
    check(odd, 1)
    check([*odd, "Foo. <|endoftext|>FOO, <|ENDOFTEXT|>. a<|startoftext|>", "FOO. Foo"], 0)
    check([None, ""], 0)


def test_word_forms_reach_the_library_once():
    cached, asked = WordIds(WORD_PATH), []
    make = cached.make
    cached.make = lambda word: (asked.append(word), make(word))[1]
    cached.column(pa.array(["Foo foo, FOO. (foo)", "foo! fOO; FOO, größe, größe."]), b"\2\0\0\0")
    assert sorted(asked) == sorted([b"foo", "größe".encode(), b"(foo", b")", b",", b".", b"!", b";"])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 10**6), min_size=1, max_size=300), st.data())
def test_huffman_round_trip(counts, data):
    counts = np.asarray(counts)
    lengths = code_lengths(counts)
    used = np.flatnonzero(counts)
    assert lengths.max(initial=0) <= MAX_BITS
    if len(used) > 1:
        assert sum(0.5 ** int(x) for x in lengths[used]) == pytest.approx(1)
    if len(used):
        sizes = np.asarray(data.draw(st.lists(st.integers(1, 700), min_size=1, max_size=5)))
        ids = np.random.default_rng(0).choice(used, sizes.sum())
        book = Codebook(lengths)
        payloads, marks = book.encode(ids, sizes)
        back = book.decode(b"".join(payloads), np.asarray([len(p) for p in payloads]), sizes, np.frombuffer(b"".join(marks), "<u4").astype(np.int64))
        assert back.tolist() == ids.tolist()


def test_token_store(spark, docs):
    got = [tuple(r) for r in TokenStore(spark, WORD_PATH, 2).write(docs).read().drop("ids").collect()]
    whole, expected = Tokenizer.from_file(WORD_PATH), []
    for i, t in fx.pairs(docs):
        ids = np.asarray([*whole.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        expected.append((i, len(ids), zlib.crc32(ids.tobytes())))
    fx.same_rows([(a, c, d) for a, _, c, d in got], expected)
    got.sort(key=lambda r: r[1])
    assert [r[1] for r in got] == [0, *np.cumsum([r[2] for r in got])[:-1].tolist()]
    names = [-1 if r[0] is None else r[0] for r in got]
    assert names == sorted(names)
    assert TokenStore(spark, WORD_PATH, 2).write(fx.empty(spark)).read().count() == 0


def test_a_token_store_opens_by_its_path(spark, docs, tmp_path):
    path = f"file://{tmp_path}/store"
    written = TokenStore(spark, WORD_PATH, 2, path).write(docs)
    want = [tuple(r) for r in written.read().collect()]
    del written
    fx.same_rows([tuple(r) for r in TokenStore.open(spark, path).read().collect()], want)
    assert spark.read.parquet(f"{path}/book").first()["tokenizer"] == WORD_FILE


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=60))
def test_bounds_hold(lengths):
    lengths = np.asarray(lengths, np.int64)
    where, offset, bins = packing.best_fit_decreasing(lengths, 100)
    assert packing.lower_bound(lengths, 100) <= bins
    for b in range(bins):
        own = np.argsort(offset[where == b])
        n, at = lengths[where == b][own], offset[where == b][own]
        assert n.sum() <= 100 and at.tolist() == (np.cumsum(n) - n).tolist()


@pytest.mark.parametrize("pieces", [60_000, 7])
def test_packing(spark, docs, monkeypatch, pieces):
    monkeypatch.setattr(packing, "PIECES_PER_PARTITION", pieces)
    got = packing.pack(docs, BYTE_PATH, 0).toPandas()
    whole, expected = Tokenizer.from_file(BYTE_PATH), []
    for i, t in fx.pairs(docs):
        ids = np.asarray([*whole.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        short = len(ids) % 2048 if len(ids) > 2048 else len(ids)
        cuts = sorted({0, *range(short, len(ids), 2048)})
        for k, (a, b) in enumerate(zip(cuts, [*cuts[1:], len(ids)], strict=True)):
            expected.append((-1 if i is None else i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())))
    got["doc_id"] = got["doc_id"].fillna(-1).astype(int)
    fx.same_rows(got[["doc_id", "piece", "start", "length", "ids_crc32"]].values.tolist(), expected)
    for _, own in got.sort_values("offset").groupby("sequence_id"):
        assert own.length.sum() <= 2048 and own.offset.tolist() == (own.length.cumsum() - own.length).tolist()
    assert (got.bins >= got.bound).all()
    assert packing.pack(fx.empty(spark), BYTE_PATH, 0).count() == 0


def test_packing_goes_on_while_it_saves(spark, docs, monkeypatch):
    monkeypatch.setattr(packing, "PIECES_PER_PARTITION", 20)
    lengths = np.random.default_rng(9).integers(22, 36, 8000)
    own = spark.createDataFrame([(k, " ".join(["again"] * (int(n) - 1)), "xx", "src", 0, 0) for k, n in enumerate(lengths)], docs.schema).repartition(4)
    got = packing.pack(own, BYTE_PATH, 0, 100).toPandas()
    assert sorted(got.doc_id) == list(range(8000)) and got.groupby("sequence_id").length.sum().max() <= 100
    assert (got.sequence_id // (1 << 56)).max() > 3


def test_quality_rules(spark, docs):
    got = quality_rules.judged(docs)
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    fx.same_rows([tuple(r) for r in got.select(*names).collect()], fx.quality_rows(fx.pairs(docs)))
    rows = got.collect()
    told = {r["rule"]: (r["n_failed"], r["n_only"]) for r in quality_rules.ablations(quality_rules.ledger(docs), 2).collect()}
    for k, rule in enumerate(quality_rules.RULES):
        assert told[rule.name] == (sum(r["failures"] >> k & 1 for r in rows), sum(r["failures"] == 1 << k for r in rows))
    kept = quality_rules.passing(docs)
    assert kept.columns == docs.columns and kept.count() == got.filter("kept").count()
    assert quality_rules.judged(fx.empty(spark)).count() == 0


def test_policies_and_ablations_read_the_stored_ledger_alone(spark, docs):
    entries = quality_rules.stored(docs)
    assert entries.inputFiles() and all("quality-ledger" in x for x in entries.inputFiles())
    assert "text" not in entries.columns
    bits = [r["failures"] for r in entries.collect()]
    for version, names in quality_rules.POLICIES.items():
        asked, base = quality_rules.mask(names), quality_rules.mask(quality_rules.BASE)
        told = quality_rules.apply_policy(entries, version)
        assert told.inputFiles() == entries.inputFiles()
        assert sorted((r["base_failed"], r["kept"]) for r in told.collect()) == sorted((b & base != 0, b & (asked | base) == 0) for b in bits)
        lost = {r["rule"]: (r["n_failed"], r["n_only"]) for r in quality_rules.ablations(entries, version).collect()}
        by_bit = {r.name: 1 << i for i, r in enumerate(quality_rules.RULES) if r.name in names}
        assert lost == {n: (sum(b & k != 0 for b in bits), sum(b & asked == k for b in bits)) for n, k in by_bit.items()}


def test_quality_rules_against_sql(docs):
    documents = docs.select("doc_id", "text").toPandas().astype({"doc_id": "Int64"})
    con = duckdb.connect()
    con.register("documents", documents)
    want = con.sql(queries.ORACLE_SQL["op3_quality_rules"])
    fx.same_rows([tuple(r) for r in quality_rules.judged(docs).select(*want.columns).collect()], want.fetchall())


def test_pii(spark, docs):
    got = pii.found(docs)
    fx.same_rows([tuple(r) for r in got.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256").collect()], fx.span_rows(fx.pairs(docs), fx.PRIVATE))
    texts = {i: t for i, t in fx.pairs(docs)}
    terms = [(r["doc_id"], texts[r["doc_id"]][int(a) : int(b)]) for r in got.collect() for k, a, b in (s.split(":") for s in r["spans"].split(",") if s) if k == "term"]
    assert [t for _, t in terms].count("zorblatt") == 5
    clean = pii.sanitised(docs)
    assert clean.columns == docs.columns
    left = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert not any("@" in (t or "") or "zorblatt" in (t or "") for t in left.values())
    spans = {r["doc_id"] for r in got.filter("spans <> ''").collect()}
    assert all(left[i] == t for i, t in texts.items() if i not in spans)
    assert pii.found(fx.empty(spark)).count() == 0


def test_terms_disclose_over_whole_documents(spark, docs):
    common = ["alpha beta gamma delta epsilon zeta eta theta iota kappa"] * 8
    far = " ".join(common)
    texts = [f"{far} text{k % 2} Zorblatt, {far} keeper@vault.example.org {far} ZORBLATT." for k in range(6)]  # far away, twice
    texts += [f"{far} (zorblatt) without the value"]
    texts += [f"{far} quimby, 1980, 4111 1111 1111 1111 {far}"]  # a value seen once; the year is no card
    texts += [f"{far} {k} nothing here" for k in range(200)]
    own = spark.createDataFrame([(k, t, "xx", "src", 0, 0) for k, t in enumerate(texts)], docs.schema)
    got = {r["doc_id"]: r["spans"] for r in pii.found(own).collect()}
    told = lambda k: [texts[k][int(a) : int(b)] for kind, a, b in (x.split(":") for x in got[k].split(",") if x) if kind == "term"]
    assert [told(k) for k in range(6)] == [["Zorblatt", "ZORBLATT"]] * 6
    assert told(6) == ["zorblatt"] and {"quimby", "1980"} <= set(told(7)) and "alpha" not in told(7)
    left = {r["doc_id"]: r["text"] for r in pii.sanitised(own).collect()}
    assert not any(x in left[k].lower() for k in range(8) for x in ("zorblatt", "quimby", "1980", "4111"))
    assert all(left[k] == texts[k] for k in range(8, len(texts)))


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 50), max_size=40))
def test_prefix_sums(values):
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    got = spark.range(1).select(pii.prefix_sums(F.array(*map(F.lit, values)) if values else F.array().cast("array<int>"))).first()[0]
    assert got == [0, *np.cumsum(values).tolist()]


def test_substring_dedup(spark, docs):
    got = substring.dedupe(docs)
    fx.same_rows([tuple(r) for r in got.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()], fx.dedup_rows(fx.pairs(docs)))
    want = {(i, h) for i, n, gone, h in fx.dedup_rows(fx.pairs(docs)) if gone < n or not gone}
    clean = substring.cleaned(docs)
    assert clean.columns == docs.columns
    assert {(r["doc_id"], fx.sha(" ".join(fx.WORD.findall(r["text"] or "")))) for r in clean.collect()} == want
    assert substring.dedupe(fx.empty(spark)).count() == 0


def expanded(rows, factors):
    """Each factor's words at its source, which must be those of the document."""
    words = {i: fx.WORD.findall(t or "") for i, t in rows if i is not None}
    for r in factors:
        assert r["source_doc"] < r["doc_id"] and r["length"] >= substring.WINDOW
        assert words[r["doc_id"]][r["first"] : r["first"] + r["length"]] == words[r["source_doc"]][r["source_first"] : r["source_first"] + r["length"]]
    return {(r["doc_id"], k) for r in factors for k in range(r["first"], r["first"] + r["length"])}


@pytest.mark.parametrize("block,segments", [(4 << 20, 1000), (3000, 2)])
def test_factors_expand_to_the_text(spark, docs, monkeypatch, block, segments):
    monkeypatch.setattr(substring, "BLOCK_BYTES", block)
    monkeypatch.setattr(substring, "SEGMENTS", segments)
    own = docs.dropDuplicates(["doc_id"])
    covered = expanded(fx.pairs(own), substring.factors(own).collect())
    for i, _, gone, _ in fx.dedup_rows(fx.pairs(own)):
        assert sum(d == i for d, _ in covered) == gone
    fx.same_rows([tuple(r) for r in substring.dedupe(docs).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()], fx.dedup_rows(fx.pairs(docs)))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from("ab"), max_size=60), min_size=1, max_size=4), st.lists(st.sampled_from("ab"), max_size=60))
def test_greedy_parse_covers_all_windows(texts, own):
    import pyarrow as pa
    import zstandard

    sink = pa.BufferOutputStream()
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": [" ".join(t) for t in texts]})
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    found = substring.Reference(substring.Block(zstandard.compress(sink.getvalue().to_pybytes()))).parse([w.encode() for w in own])
    n, held = substring.WINDOW, {tuple(t[a : a + substring.WINDOW]) for t in texts for a in range(len(t) - substring.WINDOW + 1)}
    assert {k for a, size, _, _ in found for k in range(a, a + size)} == {k for a in range(len(own) - n + 1) if tuple(own[a : a + n]) in held for k in range(a, a + n)}
    for a, size, doc, at in found:
        assert own[a : a + size] == texts[doc][at : at + size]
        assert a + size == len(own) or at + size == len(texts[doc]) or own[a + size] != texts[doc][at + size]


def test_secrets(spark, docs):
    got = secrets.scan(docs)
    fx.same_rows([tuple(r) for r in got.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256").collect()], fx.span_rows(fx.pairs(docs), fx.SECRETS))
    assert secrets.scan(fx.empty(spark)).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["password", "PassWd", "secret", "token", "api_key", "AKIA", "abcdef0123456789", "0f", " ", ":", "=", "'", '"', "A1", "Z9", "é", "_", "\n"]), max_size=16))
def test_automaton_against_regular_expressions(parts):
    text = "".join(parts)
    found = [(a, r, b) for a, r, b in secrets.scanner(secrets.RULES).spans(text.encode()) if r < 3]
    place = lambda k: len(text[:k].encode())
    assert found == sorted((place(m.start()), k, place(m.end())) for k, (_, p, ok) in enumerate(fx.SECRETS) for m in p.finditer(text) if ok(m))


@pytest.mark.parametrize("short,block", [(64, 256), (2, 3)])
def test_near_duplicates(spark, docs, monkeypatch, short, block):
    monkeypatch.setattr(near, "SHORT_LIST", short)
    monkeypatch.setattr(near, "BLOCK_OF_LIST", block)
    fx.same_rows([tuple(r) for r in near.near_duplicates(docs).collect()], fx.near_rows(fx.pairs(docs)))


def test_near_duplicate_documents_go(spark, docs):
    left = near.deduped(docs)
    assert left.columns == docs.columns
    want = {i for i, _, c, kept in fx.near_rows(fx.pairs(docs)) if kept}
    assert sorted(r["doc_id"] for r in left.collect()) == sorted(want)
    assert near.near_duplicates(fx.empty(spark)).count() == 0


def test_rows_that_share_an_id_or_have_none_are_decided_by_their_own_text(spark, docs):
    copied, alone, other = (" ".join(f"{w}{k}" for k in range(40)) for w in "abc")
    rows = [(1, copied), (None, copied), (None, alone), (5, copied), (5, other), (7, other + " end"), (None, None), (None, " ")]
    own = spark.createDataFrame([(i, t, "xx", "src", 0, 0) for i, t in rows], docs.schema)
    want = [row for row, (_, _, _, kept) in zip(rows, fx.near_rows(rows), strict=True) if kept]
    assert want == [(1, copied), (None, alone), (5, other), (None, None), (None, " ")]
    fx.same_rows([(r["doc_id"], r["text"]) for r in near.deduped(own).collect()], want)


def test_of_a_group_without_ids_one_stays(spark, docs):
    alone = " ".join(f"b{k}" for k in range(80))
    rows = [(None, alone), (None, alone + " end"), (None, alone), (3, "other words of no interest at all")]
    own = spark.createDataFrame([(i, t, "xx", "src", 0, 0) for i, t in rows], docs.schema)
    left = fx.pairs(near.deduped(own))
    assert len(left) == 2 and (3, rows[3][1]) in left and set(left) <= set(rows)


def test_classifier(spark, docs):
    labels = spark.createDataFrame([(k, None if k == 4 else k % 2, 0) for k in range(1, 60)], "doc_id long, quality int, toxic int")
    got = classifier.scored(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert classifier.scored(docs, labels.limit(0)).filter("score <> 0.5").count() == 0
    assert classifier.scored(fx.empty(spark), labels).count() == 0


def plain_scores(texts, labels):
    """Ridge by least squares over stacked rows, isotonic values by the min-max formula; every label is known once."""
    stats = {i: np.asarray(classifier.statistics(t.encode() if t else None)) for i, t in texts}
    fold = {i: zlib.crc32(str(i).encode()) % 4 for i in stats}
    fitted, calibrating = ([i for i in sorted(stats) if i in labels and fold[i] in folds] for folds in ((0, 1), (3,)))
    x = np.stack([stats[i] for i in fitted])
    mean, scale = x.mean(0), np.sqrt(np.maximum(x.var(0), 1e-8))
    z = classifier.cosines(x, mean, scale)
    width = z.shape[1]
    held = np.diag([0.0] + [np.sqrt(classifier.RIDGE * len(x) / classifier.COSINES)] * (width - 1))
    stacked = np.vstack([z, held, np.sqrt(1e-9) * np.eye(width)])
    weights = np.linalg.lstsq(stacked, np.concatenate([[labels[i] for i in fitted], np.zeros(2 * width)]), rcond=None)[0]
    raw = {i: float((classifier.cosines(stats[i][None], mean, scale) @ weights)[0]) for i in stats}
    calibrating.sort(key=raw.get)
    y, n = [labels[i] for i in calibrating], len(calibrating)
    value = [max(min(Fraction(sum(y[a : b + 1]), b + 1 - a) for b in range(k, n)) for a in range(k + 1)) for k in range(n)]
    pools = [[k for k in range(n) if value[k] == v] for v in sorted(set(value))]
    at = [np.mean([raw[calibrating[k]] for k in pool]) for pool in pools]
    steps = [(sum(y[k] for k in pool) + sum(y) / n) / (len(pool) + 1) for pool in pools]
    return {i: min(1.0, max(0.0, float(np.interp(v, at, steps)))) for i, v in raw.items()}


def test_classifier_against_a_plain_version(spark):
    d = "/root/testdata/sf0.001"
    documents, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    want = plain_scores(fx.pairs(documents), {r["doc_id"]: r["quality"] for r in labels.collect()})
    got = {r["doc_id"]: r["score"] for r in classifier.scored(documents, labels).collect()}
    assert got.keys() == want.keys() and max(abs(got[i] - want[i]) for i in want) < 1e-6


def test_classifier_is_right_on_documents_it_has_not_seen(spark):
    d = "/root/testdata/sf0.01"
    scores = classifier.scored(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet"))
    held = scores.filter("held_out").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id")
    assert held.filter("predicted = quality").count() >= 0.95 * held.count()


@pytest.mark.parametrize("block", [4096, 50])
def test_top_k(spark, monkeypatch, block):
    monkeypatch.setattr(topk, "BLOCK", block)
    rng = np.random.default_rng(1)
    x = rng.normal(0, 0.3, (400, 8)).astype(np.float32)
    x[100:140] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1001, [float("nan")] * 8), (1002, [None] * 8), (1100, [0.0] * 8), (None, [1.0] * 8), (1200, [1.0, 2.0]), (7, x[7].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    fine = [(i, np.floor(1024 * np.asarray(v, np.float32).astype(np.float64)).astype(int)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all()]
    want = []
    for k, (i, q) in enumerate(fine):
        if i % 100 == 0:
            scored = sorted(((-int(q @ c), j) for m, (j, c) in enumerate(fine) if m != k and len(c) == len(q)))[:10]
            want += [(i, r, j, -s) for r, (s, j) in enumerate(scored, 1)]
    fx.same_rows([tuple(r) for r in topk.top_k(df).collect()], want)
    assert topk.top_k(df.limit(0)).count() == 0


def test_top_k_of_large_components(spark):
    large = 2.0**40
    rows = [(0, [large + 1 / 1024, 1.0]), (1, [1023 / 1024, 1 / 1024]), (2, [1022 / 1024, 1024.0 + 1 / 1024]), (3, [1023 / 1024, 2 / 1024]), (4, [-(2.0**70), 0.0]), (5, [2.0**70, 2.0**70]), (100, [2.0**60, -(2.0**60)])]
    limit = 2**63 - 1
    whole = {i: [max(-limit - 1, min(limit, int(np.floor(1024 * np.float64(c))))) for c in v] for i, v in rows}
    want = []
    for q in (0, 100):
        scored = sorted((-max(-limit - 1, min(limit, sum(a * b for a, b in zip(whole[q], v, strict=True)))), i) for i, v in whole.items() if i != q)
        want += [(q, r, i, -s) for r, (s, i) in enumerate(scored, 1)]
    fx.same_rows([tuple(r) for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()], want)


def test_bpe(spark, docs):
    got = bpe.encode_decode(docs, WORD_PATH)
    whole, expected = Tokenizer.from_file(WORD_PATH), []
    for i, t in fx.pairs(docs):
        ids = whole.encode(t or "", add_special_tokens=False).ids
        expected.append((i, len(ids), fx.sha(" ".join(map(str, ids))), fx.sha(whole.decode(ids, skip_special_tokens=False))))
    fx.same_rows([tuple(r) for r in got.collect()], expected)


def test_bpe_merges_like_the_library():
    own, whole = bpe.SegmentTreeBpe(WORD_PATH), Tokenizer.from_file(WORD_PATH)

    @settings(max_examples=300, deadline=None)
    @given(AWKWARD)
    def same(text):
        assert own.encode(text) == whole.encode(text, add_special_tokens=False).ids

    same()
    assert own.encode("<|endoftext|>a") == whole.encode("<|endoftext|>a", add_special_tokens=False).ids


def test_bpe_columns_give_the_ids_of_whole_texts():
    own, whole = bpe.SegmentTreeBpe(WORD_PATH), Tokenizer.from_file(WORD_PATH)

    def check(texts, skip):
        got = [(n, str(ids, "utf-8"), str(decoded, "utf-8")) for n, ids, decoded in own.column(pa.array(texts, pa.string()).slice(skip))]
        ids = [whole.encode(t or "", add_special_tokens=False).ids for t in texts[skip:]]
        assert got == [(len(x), " ".join(map(str, x)), whole.decode(x, skip_special_tokens=False)) for x in ids]

    settings(max_examples=200, deadline=None)(given(st.lists(st.one_of(st.none(), AWKWARD), min_size=1, max_size=6), st.integers(0, 2))(check))()
    odd = ["Dog's. dog's, x'. 'S.'s a-'. ...", "× a×. ÷, é×! —, a—. ½. 12.5, (3)", "W\u030a H\u0331, e\u0301. E\u0301A, ŉ! =\u0338 a=\u0338.", "I\u0307. \u0130. ſ. Σ. слово. СЛОВО, 字。 a\x1cb. \ufeffa.", None, "", " \t\n", "x" * 200 + "."]
    check(odd, 1)
    check([*odd, "Foo. <|endoftext|>FOO, <|ENDOFTEXT|>. a<|startoftext|> <| .<|", "FOO. Foo"], 0)
    for few in ([None, ""], ["\u3000  "], ["\u3000", "a"], []):
        check(few, 0)
    check([" ".join(f"a{chr(c)}b {chr(c)} {chr(c)}. x.{chr(c)}" for c in range(0x21, 0x250))], 0)


def test_bpe_of_parts_of_every_length_merges_like_the_library():
    own, whole, rng = bpe.SegmentTreeBpe(WORD_PATH), Tokenizer.from_file(WORD_PATH), np.random.default_rng(3)
    parts = sorted({"".join(rng.choice(list(letters), n)) for n in range(1, 140) for letters in ("etaoinshr", "ab", "aeéß", "字語日本", "q") for _ in range(4)})
    ids, counts = own.many(pa.array(parts, pa.large_string()))
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [whole.encode(x, add_special_tokens=False).ids for x in parts]


def test_bpe_takes_equal_parts_of_a_column_once_and_their_merges_together(monkeypatch):
    own, asked, scalar, texts = bpe.SegmentTreeBpe(WORD_PATH), [], [], ["Foo foo, FOO. (foo)", "foo! fOO; FOO, größe, größe."]
    many = own.many
    monkeypatch.setattr(own, "many", lambda parts: (asked.extend(parts.to_pylist()), many(parts))[1])
    monkeypatch.setattr(own, "merged", lambda ids: scalar.append(ids))
    assert [x[0] for x in own.column(pa.array(texts))] == [len(Tokenizer.from_file(WORD_PATH).encode(t, add_special_tokens=False).ids) for t in texts]
    assert sorted(asked) == sorted(["foo", "größe", "(", ")", ",", ".", "!", ";"]) and not scalar
