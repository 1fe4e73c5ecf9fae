import collections
import math
import re
import unicodedata

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tessella.llm import near
from tessella.llm.common import Scratch
from tessella.llm.tokens import BYTE_FILE
from tests.llm import fixture as fx


def test_each_stage_keeps_the_columns_and_decides(spark):
    docs = fx.documents(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "").cache()
        assert out.columns == docs.columns and out.count() <= docs.count(), name
        docs = out
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, "").toPandas()
    assert set(packed.doc_id.dropna()) == {r["doc_id"] for r in docs.collect() if r["doc_id"] is not None}
    assert packed.groupby("sequence_id").length.sum().max() <= 2048


def test_stages_take_empty_tables(spark):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, fx.empty(spark), "").count() == 0, name


def test_the_whole_run(spark):
    packed = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert packed and max(collections.Counter(r["sequence_id"] for r in packed).values()) >= 1


def test_near_copies_go_from_a_similarity_of_08(spark):
    base = [f"w{k}" for k in range(300)]
    rows = [(1, " ".join(base), "xx", "src", 0, 1)]
    for changed in range(4, 14):  # each changed word takes five shingles
        words = [*base]
        for k in range(changed):
            words[20 * k + 10] = f"c{changed}x{k}"
        rows.append((changed, " ".join(words), "xx", "src", 0, 1))
    docs = spark.createDataFrame(rows, fx.documents(spark).schema)
    want = {i for i, _, _, kept in fx.near_rows(fx.pairs(docs), 80) if kept}
    assert want < {i for i, _, _, kept in fx.near_rows(fx.pairs(docs), 85) if kept}
    got = dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs, "")
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(want)


def test_the_overlap_follows_the_similarity():
    for percent in (80, 85, 90):
        least = near.overlap(percent)
        chance = sum(math.comb(near.SKETCH, k) * (percent / 100) ** k * (1 - percent / 100) ** (near.SKETCH - k) for k in range(least))
        assert chance <= 1e-12
    assert near.overlap(80) < near.overlap(85)


def plain_quality(rows):
    for (i, t), (_, n, chars, symbols, dup, _, base) in zip(rows, fx.quality_rows(rows), strict=True):
        t = t or ""
        kinds = [unicodedata.category(c) for c in t]
        letters, upper, lines = sum(k[0] == "L" for k in kinds), kinds.count("Lu"), sum(bool(fx.WORD.search(x)) for x in t.split("\n"))
        distinct = len(set(fx.WORD.findall(t)))
        few = n >= 10 and 4 * distinct < n and distinct * distinct < 16 * n
        fails = base or 10 * symbols > n or (lines >= 5 and 100 * dup > 30 * lines) or (upper > 20 and 2 * upper > letters) or 5 * t.count("!") > n or chars > 20 * n or few or 2 * letters < chars
        if not fails:
            yield i, t


def plain_sanitised(rows):
    """Spans by the patterns, terms by PMI over whole documents."""
    word = re.compile(r"[^\W_](?:[^\x20\x09-\x0D]*[^\W_])?")
    told = []
    for _, t in rows:
        spans = sorted((m.start(), m.end(), k) for k, p, ok in fx.PRIVATE for m in p.finditer(t or "") if ok(m))
        around = list(t or "")
        for a, b, _ in spans:
            around[a:b] = " " * (b - a)
        words = [(m[0].lower(), m.start(), m.end()) for m in word.finditer("".join(around)) if len(m[0]) >= 3]
        values = {f"{k}:{re.sub('[^0-9]', '', t[a:b]) if k in ('card', 'phone') else t[a:b].lower()}" for a, b, k in spans}
        told.append((spans, words, {w for w, _, _ in words}, values))
    of_term, of_value, texts, both = collections.Counter(), collections.Counter(), collections.defaultdict(set), collections.defaultdict(list)
    for (_, _, terms, values), (_, t) in zip(told, rows, strict=True):
        of_term.update(terms)
        of_value.update(values)
        for v in values:
            texts[v].add(t)
            for w in terms:
                both[v, w].append(t)
    n, share = len(rows), {}
    for (v, w), seen in both.items():
        if of_value[v] < n and len(set(seen)) >= min(3, len(texts[v])):
            share[w] = max(share.get(w, 0), math.log2(len(seen) * n / (of_term[w] * of_value[v])) / -math.log2(of_value[v] / n))
    for (i, t), (spans, words, _, _) in zip(rows, told, strict=True):
        cuts = []
        for a, b, mark in sorted([(a, b, f"<{k.upper()}>") for a, b, k in spans] + [(a, b, "" if share[w] >= 1 - 1e-9 else "<TERM>") for w, a, b in words if share.get(w, 0) >= 0.9 - 1e-9]):
            if cuts and cuts[-1][1] > a:
                cuts[-1][1] = max(cuts[-1][1], b)
            else:
                cuts.append([a, b, mark])
        for a, b, mark in reversed(cuts):
            t = t[:a] + mark + t[b:]
        yield i, t


def test_stages_against_plain_versions(spark):
    stages, docs = dict(corpus_pipeline.STAGES), fx.documents(spark).cache()
    step = lambda name: Scratch(spark, "test").put(name, stages[name](spark, docs, ""))
    before, docs = fx.pairs(docs), step("quality_rules")
    fx.same_rows(fx.pairs(docs), plain_quality(before))
    before, docs = fx.pairs(docs), step("near_dedup")
    fx.same_rows(fx.pairs(docs), {row for row, (*_, kept) in zip(before, fx.near_rows(before, 80), strict=True) if kept})
    before, docs = fx.pairs(docs), step("substring_dedup")
    fx.same_rows([(i, fx.sha(" ".join(fx.WORD.findall(t or "")))) for i, t in fx.pairs(docs)], [(i, h) for i, n, gone, h in fx.dedup_rows(before) if gone < n or not gone])
    before, docs = fx.pairs(docs), step("pii")
    fx.same_rows(fx.pairs(docs), plain_sanitised(before))
    tokens = Tokenizer.from_file(public_tokenizers.path(BYTE_FILE))
    sizes = {i: len(tokens.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in fx.pairs(docs)}
    packed = stages["packing"](spark, docs, "").toPandas()
    assert packed.groupby("doc_id").length.sum().to_dict() == sizes and packed.groupby("sequence_id").length.sum().max() <= 2048
