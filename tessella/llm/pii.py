"""Operator 4: personal data by patterns, and the terms that give it away by co-occurrence.

Patterns find emails, addresses, cards and phones in whole texts. The terms of a document are the words of its whole text around the
valid spans. Over the whole corpus a term t discloses a value e if PMI(t; e) >= alpha * IC(e), IC(e) = -log2 p(e), p over documents:
knowing the term then leaves less than (1 - alpha) of the value's information. A term must be with the value in SUPPORT different
texts, so copies of one text are no evidence; of a value seen in fewer different texts, in all of them, as no more evidence
can be had. Every occurrence of a disclosing term, also in documents without the value, becomes a span of kind ``term``;
sanitising generalises them to a placeholder, and removes them if they disclose everything (alpha 1).

DataFrame functions only. Regular expressions are possessive and start at the borders of runs, so their time is linear in the text.
Null and empty texts have no spans (the digest of an empty string). Repeated rows each give a row and count as documents; a null
doc_id stays null. Other columns are ignored by ``found`` and kept, whatever their names, by ``sanitised``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import Scratch, id_and_text
from tessella.llm.quality_rules import let

KINDS = ("email", "ip", "card", "phone")
_LOCAL = r"[A-Za-z0-9._%+-]"
#: Fixed patterns, possessive where nothing can be given back; what may precede a first character is excluded but after a match.
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What any valid match contains; texts without it are not split.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){11}", "phone": r"\+[0-9]"}
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: A word from its first letter or digit to its last.
TERM = r"[\p{L}\p{N}](?:[^\x20\x09-\x0D]*[\p{L}\p{N}])?"
SUPPORT = 3
ALPHA = 0.9
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 16 << 20  # of terms or values; more are joined by shuffle
_SPAN = "array<struct<start:int,kind:int,end:int,bstart:int,bend:int,value:string>>"
_PARTS = "array<struct<start:int,kind:int,end:int,bstart:int,bend:int,share:double>>"


def prefix_sums(values: Column) -> Column:
    """Sums before each entry and, last, of all: blocks of about the square root of the length, so n entries cost n**1.5 at most."""
    zero = F.array(F.lit(0))
    scan = lambda x: F.aggregate(x, zero, lambda acc, v: F.concat(acc, F.array(F.element_at(acc, -1) + v)))

    def blocked(x: Column) -> Column:
        width = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(x))).cast("int"))
        parts = let(width, lambda b: F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / b).cast("int")), lambda k: scan(F.slice(x, k * b + 1, b))))

        def joined(p: Column) -> Column:
            totals = scan(F.transform(p, lambda s: F.element_at(s, -1)))
            body = let(totals, lambda t: F.flatten(F.transform(p, lambda s, k: F.transform(F.slice(s, 1, F.size(s) - 1), lambda v: v + F.get(t, k)))))
            return F.concat(body, F.array(F.element_at(totals, -1)))

        return let(parts, joined)

    return F.when(F.size(values) == 0, zero).otherwise(let(values, blocked))


def _luhn(match: Column) -> Column:
    digits = F.transform(F.filter(F.split(F.reverse(F.translate(match, " -", "")), ""), lambda c: c != ""), lambda c: c.cast("int"))
    doubled = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    terms = F.transform(digits, lambda d, i: F.when(i % 2 == 1, doubled(d)).otherwise(d))
    return F.aggregate(terms, F.lit(0), lambda a, b: a + b) % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        return match.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    n = F.length(F.regexp_replace(match, r"[^0-9]++", ""))
    if kind == "card":
        return F.when(n.between(12, 19), _luhn(match)).otherwise(F.lit(False))
    return n.between(9, 15) if kind == "phone" else F.lit(True)


def _value(kind: str, match: Column) -> Column:
    """What the same person's data have in common in all spellings."""
    return F.concat(F.lit(f"{kind}:"), F.regexp_replace(match, r"[^0-9]++", "") if kind in ("card", "phone") else F.lower(match))


def _placed(text: Column, pattern: str | Column, row) -> Column:
    """``row(match, start, end, bstart, bend)`` of each match, with places in code points and bytes: matches and what lies between add up to the whole text."""

    def placed(found: Column, gaps: Column) -> Column:
        lengths = lambda size: prefix_sums(F.flatten(F.transform(found, lambda m, k: F.array(size(F.get(gaps, k)), size(m)))))
        rows = lambda c, o: F.transform(found, lambda m, k: row(m, F.get(c, 2 * k + 1), F.get(c, 2 * k + 2), F.get(o, 2 * k + 1), F.get(o, 2 * k + 2)))
        return let(lengths(F.length), lambda c: let(lengths(F.octet_length), lambda o: rows(c, o)))

    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    return let(F.regexp_extract_all(text, pattern, F.lit(0)), lambda f: let(F.split(text, pattern, -1), lambda g: placed(f, g)))


def _spans(text: Column, kind: str) -> Column:
    """Valid matches with their places."""
    hint = F.contains(text, F.lit("@")) if kind == "email" else text.rlike(HINTS[kind])

    def row(m: Column, start: Column, end: Column, bstart: Column, bend: Column) -> Column:
        value = F.when(_valid(kind, m), _value(kind, m))
        return F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("kind"), end.alias("end"), bstart.alias("bstart"), bend.alias("bend"), value.alias("value"))

    whole = F.filter(_placed(text, PATTERNS[kind], row), lambda s: s["value"].isNotNull())
    return F.when(hint, whole.cast(_SPAN)).otherwise(F.array().cast(_SPAN))


def base_spans(text: Column) -> Column:
    """All valid matches by start, then by kind."""
    own = F.coalesce(text, F.lit(""))
    return F.sort_array(F.concat(*[_spans(own, k) for k in KINDS]))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in (*KINDS, "term")])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _plain(spans: Column, share: float = 0.0) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["bstart"].alias("bstart"), s["bend"].alias("bend"), F.lit(share).alias("share")))


def _around(text: Column, base: Column) -> Column:
    """The text with blanks for the base spans, which are ASCII: what is left keeps its places."""
    own = F.coalesce(text, F.lit(""))
    return F.when(F.size(base) == 0, own).otherwise(_rewritten(own, _plain(base), lambda c: F.repeat(F.lit(" "), (c["b"] - c["a"]).cast("int"))))


def _terms(around: Column) -> Column:
    """The distinct terms, in lower case."""
    long = F.filter(F.array_distinct(F.regexp_extract_all(around, F.lit(TERM), F.lit(0))), lambda m: F.length(m) >= 3)
    return F.array_distinct(F.transform(long, F.lower))


def _occurrences(around: Column, hits: Column) -> Column:
    """Every occurrence of the ``hits`` (term, share) with its places. One expression, of the spellings that this text has, finds them: a word
    with such a spelling between its first and its last letter or digit."""
    spelled = F.filter(F.array_distinct(F.regexp_extract_all(around, F.lit(TERM), F.lit(0))), lambda m: F.array_contains(F.transform(hits, lambda h: h["term"]), F.lower(m)))
    quoted = F.array_join(F.transform(spelled, lambda m: F.regexp_replace(m, r"([^\p{L}\p{N}])", r"\\$1")), "|")
    pattern = F.concat(F.lit(r"(?<![^\x20\x09-\x0D])[^\p{L}\p{N}\x20\x09-\x0D]*+(?:"), quoted, F.lit(r")(?![^\x20\x09-\x0D]*[\p{L}\p{N}])"))

    def row(m: Column, start: Column, end: Column, bstart: Column, bend: Column) -> Column:
        lead = F.regexp_extract(m, r"^[^\p{L}\p{N}]*+", 0)
        share = let(F.lower(F.substring(m, F.length(lead) + 1, F.length(m))), lambda t: F.get(F.filter(hits, lambda h: h["term"] == t), F.lit(0))["share"])
        return F.struct((start + F.length(lead)).alias("start"), F.lit(len(KINDS)).alias("kind"), end.alias("end"), (bstart + F.octet_length(lead)).alias("bstart"), bend.alias("bend"), share.alias("share"))

    return let(pattern, lambda p: _placed(around, p, row)).cast(_PARTS)


def _numbered(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """row, doc_id and text, and every other column under a number: written once, so that every later plan sees the same row numbers."""
    names = docs.columns
    others = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names) if c != "text"]
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *others)
    return scratch.put("rows", own.withColumn("row", F.monotonically_increasing_id()))


def _told(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """One row for each document: a row number, its base spans and their values, a hash of the text and its terms."""
    one = rows.select("row", "doc_id", "text", F.inline(F.array(F.struct(base_spans(F.col("text")).alias("base")))))
    slim = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["bstart"].alias("bstart"), s["bend"].alias("bend")))
    values = F.array_distinct(F.transform("base", lambda s: s["value"]))
    return scratch.put("told", one.select("row", "doc_id", slim.alias("base"), values.alias("values"), F.xxhash64("text").alias("context"), _terms(_around(F.col("text"), F.col("base"))).alias("terms")))


def _fits(df: DataFrame, column: str) -> bool:
    """Small enough to broadcast, by rows and by bytes."""
    n, size = df.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(column) + 40), F.lit(0))).first()
    return n <= BROADCAST_ROWS and size <= BROADCAST_BYTES


def disclosing(told: DataFrame, scratch: Scratch, alpha: float = ALPHA, support: int = SUPPORT) -> DataFrame:
    """(value, term, share): PMI(term; value) / IC(value) of the pairs that reach alpha."""
    total = told.count()
    valued = told.filter(F.size("values") > 0)
    seen = valued.select("row", "context", F.explode("values").alias("value"))
    values = seen.groupBy("value").agg(F.count("*").alias("of_value"), F.least(F.lit(support), F.countDistinct("context")).alias("needed")).filter(F.col("of_value") < total)
    values = scratch.put("values", values)
    values = F.broadcast(values) if _fits(values, "value") else values
    held = seen.join(values, "value").groupBy("row").agg(F.collect_list(F.struct("value", "of_value", "needed")).alias("held"))
    # of_term: documents with the term; near: those of them that have any value
    counted = told.select((F.size("values") > 0).cast("long").alias("has"), F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("of_term"), F.sum("has").alias("near"))
    counted = scratch.put("counted", counted.filter("near > 0"))
    share = lambda both: F.log2(both * F.lit(total) / (F.col("of_term") * F.col("of_value"))) / -F.log2(F.col("of_value") / F.lit(total))
    # a common term reaches alpha only with a value that is as common: the others are no pairs
    least = 8
    while not _fits(counted.filter(F.col("of_term") > least), "term"):
        least *= 2
    common = counted.filter(F.col("of_term") > least)
    pairs = valued.select("row", "context", "terms").join(held, "row").select("context", "terms", F.inline("held")).select("context", "value", "of_value", "needed", F.explode("terms").alias("term"))
    pairs = pairs.join(F.broadcast(common), "term", "left").filter(F.col("of_term").isNull() | (share(F.least("near", "of_value")) >= alpha - 1e-9))
    pairs = pairs.groupBy("value", "term", "of_value", "needed").agg(F.count("*").alias("both"), F.countDistinct("context").alias("contexts")).filter("contexts >= needed")
    rated = pairs.join(counted, "term").select("value", "term", share(F.col("both")).alias("share"))
    return rated.filter(F.col("share") >= alpha - 1e-9)


def _marked(rows: DataFrame, scratch: Scratch, alpha: float, support: int) -> tuple[DataFrame, DataFrame]:
    """All of ``_told``, and (row, base, hits) of the rows that have base spans or disclosing terms."""
    told = _told(rows, scratch)
    terms = scratch.put("disclosing", disclosing(told, scratch, alpha, support).groupBy("term").agg(F.max("share").alias("share")))
    terms = F.broadcast(terms) if _fits(terms, "term") else terms
    hits = told.select("row", F.explode("terms").alias("term")).join(terms, "term").groupBy("row").agg(F.collect_list(F.struct("term", "share")).alias("hits"))
    marked = scratch.put("marked", told.select("row", "base").join(hits, "row", "left").filter((F.size("base") > 0) | F.col("hits").isNotNull()))
    return told, marked


def _with_terms(texts: DataFrame) -> DataFrame:
    """Adds ``terms``, the spans of the hits, computed once for each row."""
    own = F.when(F.col("hits").isNotNull(), _occurrences(_around(F.col("text"), F.col("base")), F.col("hits"))).otherwise(F.array().cast(_PARTS))
    kept = [c for c in texts.columns if c != "hits"]
    return texts.select(*kept, F.inline(F.array(F.struct(own.alias("terms")))))


def found(docs: DataFrame, alpha: float = ALPHA, support: int = SUPPORT) -> DataFrame:
    """doc_id, n_<kind>, base_sha256, and spans: the base ones and the disclosing terms."""
    scratch = Scratch(docs.sparkSession, "pii")
    rows = _numbered(id_and_text(docs), scratch)
    told, marked = _marked(rows, scratch, alpha, support)
    terms = _with_terms(rows.select("text", "row").join(marked.filter("hits is not null"), "row"))
    terms = scratch.put("terms", terms.select("row", "terms"))
    scratch.keep("told", "terms")
    flat = lambda name: F.transform(name, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    both = told.select("row", "doc_id", "base").join(terms, "row", "left")
    every = F.sort_array(F.concat(flat("base"), F.coalesce(flat("terms"), F.array().cast("array<struct<start:int,kind:int,end:int>>"))))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    counts = [count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return both.select("doc_id", *counts, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(every).alias("spans"))


def _rewritten(text: Column, spans: Column, mark=lambda c: c["mark"]) -> Column:
    """The text with each span replaced by ``mark(cut)``; of overlapping spans the first decides, and the cut goes to the end of the last."""
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in (*KINDS, "term")])
    blank = F.array().cast("array<struct<a:int,b:int,mark:string>>")

    def merged(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        own = F.struct(s["bstart"].alias("a"), s["bend"].alias("b"), F.when(s["share"] >= 1 - 1e-9, F.lit("")).otherwise(F.get(names, s["kind"])).alias("mark"))
        over = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["a"].alias("a"), F.greatest(last["b"], s["bend"]).alias("b"), last["mark"].alias("mark"))))
        return F.when(F.size(acc) == 0, F.array(own)).when(F.try_element_at(acc, F.lit(-1))["b"] > s["bstart"], over).otherwise(F.concat(acc, F.array(own)))

    def pieces(cuts: Column, raw: Column) -> Column:
        before = lambda k: F.when(k == 0, F.lit(0)).otherwise(F.get(cuts, k - 1)["b"])
        kept = F.transform(cuts, lambda c, k: F.concat(F.decode(F.substring(raw, before(k) + 1, c["a"] - before(k)), "UTF-8"), mark(c)))
        return F.concat(F.array_join(kept, ""), F.decode(F.substring(raw, F.element_at(cuts, -1)["b"] + 1, F.octet_length(raw)), "UTF-8"))

    return let(F.aggregate(spans, blank, merged), lambda c: let(F.encode(text, "UTF-8"), lambda raw: pieces(c, raw)))


def sanitised(docs: DataFrame, alpha: float = ALPHA, support: int = SUPPORT) -> DataFrame:
    """The documents, all columns, with every span replaced; n_chars, if there, follows the text."""
    scratch, names = Scratch(docs.sparkSession, "pii"), docs.columns
    rows = _numbered(docs, scratch)
    _, marked = _marked(rows, scratch, alpha, support)
    scratch.keep("rows", "marked")
    others = [f"c{i}" for i, c in enumerate(names) if c != "text"]
    rows = _with_terms(rows.join(marked, "row", "left").select(*others, "text", "base", "hits"))
    every = F.sort_array(F.concat(_plain(F.col("base")), "terms"))
    new = F.when(F.col("base").isNull(), F.col("text")).otherwise(_rewritten(F.col("text"), every))
    out = rows.select(*others, F.inline(F.array(F.struct(new.alias("new")))))
    n_chars = lambda i: F.coalesce(F.length("new").cast(docs.schema["n_chars"].dataType), F.col(f"c{i}"))
    return out.select(*[(F.col("new") if c == "text" else n_chars(i) if c == "n_chars" else F.col(f"c{i}")).alias(c) for i, c in enumerate(names)])
