"""Personal data: patterns, and information-theoretic sanitisation (DataFrame functions only).

Base spans are found by four patterns (email, ip, card, phone), each from left to right without overlap.
Beyond these, words can give an entity away.  Protected entities are the four kinds, and every single value (an address, a number) that
at least ``MIN_DOCS`` documents hold; a value of fewer documents cannot reach the joint minimum with any term, and values (or terms) that stand
in the same documents are counted once.  Corpus counts
of documents estimate how strongly a term t reveals an entity e: disclosure = PMI(t; e) / IC(e), with PMI = log2(p(t,e) / (p(t) p(e)))
and IC = -log2 p(e); it is 1 for a term that only stands in documents with e.  Terms with at least ``MIN_DOCS``
joint documents are generalised from ``GENERALISE`` on and removed from ``REMOVE`` on, wherever they stand: also in documents without the
entity, as they give it away there too.

The counts cover all documents and all words (a letter, then letters and digits).  Terms are counted in documents with
entities first; only terms that reach the joint minimum are then counted in the whole corpus (a broadcast of checked size, else a
shuffled join).

Defined results: null texts are empty; texts are searched whole; repeated rows get equal spans; null ids are rows like any
other; an empty table gives an empty table; extra columns are ignored; where every document has an entity, its IC is 0 and nothing
reveals it; spans that overlap are replaced as one, by what the first of them is replaced with.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewise.plans.scratch import Scratch, join_checked

KINDS = ("email", "ip", "card", "phone")
#: The patterns with possessive repetition, and starts only where a run of their characters starts: equal matches
#: in linear time and without recursion on long runs.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
TERM = r"(?<![\p{L}\p{N}])\p{L}[\p{L}\p{N}]*+"
MIN_DOCS = 5
GENERALISE, REMOVE = 0.8, 0.95
_DIGITS = "regexp_replace(s.value, '[^0-9]', '')"
#: Which matches count, over a span s.
_VALID = {
    "ip": "forall(split(s.value, '[.]'), p -> length(ltrim('0', p)) <= 3 and coalesce(try_cast(ltrim('0', p) as int), 0) <= 255)",
    "card": f"""length({_DIGITS}) between 13 and 19 and aggregate(sequence(1, length({_DIGITS})), 0, (a, i) -> a +
        case when i % 2 = 1 then cast(substring({_DIGITS}, -i, 1) as int)
             else 2 * cast(substring({_DIGITS}, -i, 1) as int) - if(cast(substring({_DIGITS}, -i, 1) as int) > 4, 9, 0) end) % 10 = 0""",
    "phone": f"length({_DIGITS}) between 9 and 15",
}
_EMPTY = "array<struct<start:int,end:int,value:string>>"


def _running(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """Running results of an associative function over an array, by doubling shifts: n log n steps, however long it is."""
    shifts = F.transform(F.sequence(F.lit(0), F.ceil(F.log2(F.size(values) + 1.0)).cast("int")), lambda k: F.pow(F.lit(2), k).cast("int"))
    return F.aggregate(shifts, values, lambda acc, d: F.transform(acc, lambda v, i: F.when(i >= d, join(F.get(acc, i - d), v)).otherwise(v)))


def _lay_out(text: Column, pattern: Column, matches: Column) -> Column:
    """Spans (start, end, value) of the matches: their places follow from the lengths of what stands between them."""
    lengths = F.zip_with(matches, F.split(text, pattern, -1), lambda m, p: F.coalesce(F.length(m), F.lit(0)) + F.length(p))
    ends = _running(F.slice(lengths, F.lit(1), F.size(matches)), lambda a, b: a + b)
    spans = F.zip_with(matches, ends, lambda m, e: F.struct((e - F.length(m)).alias("start"), e.alias("end"), m.alias("value")))
    return F.when(F.size(matches) > 0, spans).otherwise(F.array().cast(_EMPTY))


def base_spans(docs: DataFrame, text: str) -> DataFrame:
    """Adds a column of spans for each kind."""
    found = docs.withColumns({f"__m_{k}": F.regexp_extract_all(F.col(text), F.lit(PATTERNS[k]), F.lit(0)) for k in KINDS})
    laid = found.withColumns({f"__s_{k}": _lay_out(F.col(text), F.lit(PATTERNS[k]), F.col(f"__m_{k}")) for k in KINDS})
    return laid.withColumns({k: F.expr(f"filter(__s_{k}, s -> {_VALID[k]})") if k in _VALID else F.col(f"__s_{k}") for k in KINDS}).drop(*[f"__{x}_{k}" for x in "ms" for k in KINDS])


def _written(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda s: F.concat(F.lit(f"{kind}:"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string")))


def _words(text: Column) -> Column:
    """Distinct terms of a text, lower-cased."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0)))


def _terms(text: Column) -> Column:
    """Distinct terms outside of what looks like base entities."""
    return _words(reduce(lambda t, k: F.regexp_replace(t, PATTERNS[k], " "), KINDS, text))


def disclosure(entities: DataFrame, docs: DataFrame, scratch: Scratch, min_docs: int = MIN_DOCS) -> DataFrame:
    """(term, level, disclosure) of the terms whose disclosure of any entity reaches a threshold; level is 'general' or 'removed'.

    ``entities``: documents with base spans (rid, text, and spans by kind); ``docs``: all (rid, text).
    """
    n = docs.count()
    kinds = F.concat(*[F.when(F.size(k) > 0, F.array(F.lit(k))).otherwise(F.array().cast("array<string>")) for k in KINDS])
    named = lambda k: F.transform(k, lambda s: F.concat(F.lit(f"{k}:"), F.lower(s["value"])))
    values = F.array_distinct(F.concat(*map(named, KINDS)))
    held = scratch.write(entities.select("rid", F.explode(values).alias("entity")), "values")
    # Entities with the same documents reveal the same: one of them stands for all. Terms with the same documents have the same joint counts.
    # Sets of documents are told apart by their size and two sums of hashes.
    signed = [F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("rid")).alias("s"), F.bit_xor(F.xxhash64(F.lit(7), "rid")).alias("t")]
    often = held.groupBy("entity").agg(*signed).filter(F.col("n") >= min_docs).groupBy("n", "s", "t").agg(F.min("entity").alias("entity"))
    often = scratch.write(often.select("entity", F.col("n").alias("de")), "often")
    terms = scratch.write(entities.select("rid", kinds.alias("kinds"), F.explode(_terms(F.col("text"))).alias("term")), "terms")

    by_kind = terms.groupBy("term").agg(*[F.count_if(F.array_contains("kinds", k)).alias(k) for k in KINDS])
    by_kind = by_kind.select("term", F.inline(F.array(*[F.struct(F.lit(k).alias("entity"), F.col(k).alias("joint")) for k in KINDS])))
    by_kind = scratch.write(by_kind.filter(F.col("joint") >= min_docs), "by-kind")
    # A term has no more documents in common with a value than with the value's kind.
    able = scratch.write(by_kind.select("term").distinct(), "able")
    named = scratch.write(join_checked(terms.select("rid", "term"), able, "term", "left_semi", max_rows=500_000), "named")
    alike = scratch.write(named.groupBy("term").agg(*signed), "alike")
    heads = scratch.write(alike.groupBy("n", "s", "t").agg(F.min("term").alias("head")), "heads")
    classes = scratch.write(join_checked(alike, heads, ["n", "s", "t"], max_rows=500_000).select("term", "head"), "classes")
    valued = join_checked(held, often.select("entity"), "entity", "left_semi")
    of_heads = join_checked(named, heads.select(F.col("head").alias("term")), "term", "left_semi", max_rows=500_000)
    by_value = of_heads.select("rid", F.col("term").alias("head")).join(valued, "rid").groupBy("head", "entity").agg(F.count(F.lit(1)).alias("joint"))
    by_value = scratch.write(by_value.filter(F.col("joint") >= min_docs), "by-value").join(classes, "head")
    joint = scratch.write(by_kind.unionByName(by_value.select("term", "entity", "joint")), "joint")
    sizes = entities.agg(*[F.count_if(F.size(k) > 0).alias(k) for k in KINDS]).select(F.inline(F.array(*[F.struct(F.lit(k).alias("entity"), F.col(k).alias("de")) for k in KINDS])))

    asked = scratch.write(joint.select("term").distinct(), "asked")
    total = join_checked(docs.select(F.explode(_words(F.col("text"))).alias("term")), asked, "term", "left_semi", max_rows=500_000).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    each = joint.join(total, "term").join(sizes.unionByName(often), "entity").filter(F.col("de") < n)
    ratio = F.log2(F.col("joint") * F.lit(float(n)) / (F.col("df") * F.col("de").cast("double"))) / -F.log2(F.col("de") / F.lit(float(n)))
    most = each.groupBy("term").agg(F.max(ratio).alias("disclosure")).filter(F.col("disclosure") >= GENERALISE)
    return scratch.write(most.select("term", F.when(F.col("disclosure") >= REMOVE, F.lit("removed")).otherwise(F.lit("general")).alias("level"), "disclosure"), "disclosing")


def _term_spans(name: str) -> Column:
    """Spans of the terms of an array column in the text."""
    pattern = F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}])(?:"), F.array_join(F.sort_array(name), "|"), F.lit(r")(?![\p{L}\p{N}])"))
    found = _lay_out(F.col("text"), pattern, F.regexp_extract_all("text", pattern, F.lit(0)))
    return F.when(F.size(name) > 0, found).otherwise(F.array().cast(_EMPTY))


def _outside(spans: str, others: Column) -> Column:
    """Spans that overlap none of the others: no other begins before and ends inside or after, none begins inside."""
    mark = lambda c, own: F.transform(c, lambda s: F.struct(s["start"].alias("start"), F.lit(own).alias("own"), s["end"].alias("end"), s["value"].alias("value")))
    every = F.array_sort(F.concat(mark(others, False), mark(F.col(spans), True)))
    before = _running(F.transform(every, lambda s: F.when(s["own"], F.lit(0)).otherwise(s["end"])), F.greatest)
    after = F.reverse(_running(F.reverse(F.transform(every, lambda s: F.when(s["own"], F.lit(2**31 - 1)).otherwise(s["start"]))), F.least))
    tested = F.zip_with(F.zip_with(every, before, lambda s, b: F.struct(s.alias("s"), b.alias("b"))), after, lambda x, a: F.struct(x["s"].alias("s"), x["b"].alias("b"), a.alias("a")))
    free = F.filter(tested, lambda x: x["s"]["own"] & (x["b"] <= x["s"]["start"]) & (x["a"] >= x["s"]["end"]))
    plain = F.transform(free, lambda x: F.struct(x["s"]["start"].alias("start"), x["s"]["end"].alias("end"), x["s"]["value"].alias("value")))
    return F.when(F.size(spans) > 0, plain).otherwise(F.array().cast(_EMPTY))


#: What spans are replaced with.
TAGS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "general": "[TERM]", "removed": ""}


def _replaced(text: Column) -> Column:
    """The text with its spans replaced; spans that overlap are one, with the tag of the first."""
    tagged = lambda k, tag: F.transform(k, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(tag).alias("tag")))
    every = F.array_sort(F.concat(*[tagged(k, tag) for k, tag in TAGS.items()]))
    upto = _running(F.transform(every, lambda s: s["end"]), F.greatest)
    prior = F.slice(F.concat(F.array(F.lit(0)), upto), F.lit(1), F.size(every))
    laid = F.zip_with(every, prior, lambda s, b: F.struct(s["start"].alias("start"), s["tag"].alias("tag"), b.alias("before")))
    heads = F.filter(laid, lambda x: (x["before"] <= x["start"]))
    # A head ends what stands before it: the text between the last end and its start, then its tag.
    chars = F.split(text, "")
    pieces = F.transform(heads, lambda x: F.struct(x["before"].alias("a"), x["start"].alias("z"), x["tag"].alias("tag")))
    rest = F.array(F.struct(F.array_max(upto).alias("a"), F.lit(2**31 - 1).alias("z"), F.lit("").alias("tag")))
    built = F.transform(F.array(chars), lambda c: F.array_join(F.transform(F.concat(pieces, rest), lambda x: F.concat(F.array_join(F.slice(c, x["a"] + 1, F.least(x["z"], F.size(c)) - x["a"]), ""), x["tag"])), ""))
    return F.when(F.size(every) > 0, built[0])


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS) -> DataFrame:
    """One row per document: doc_id, counts of base spans, base_sha256, spans, and sanitised (the text with its spans replaced).

    ``spans`` lists all spans as kind:start:end, base ones by kind, then general and removed terms. ``sanitised`` is null where
    nothing is replaced.
    """
    scratch = Scratch(docs.sparkSession, "pii")
    src = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # Rows are numbered in a table, so that a number means the same row whenever it is read.
    base = scratch.write(base_spans(src, "text").withColumn("rid", F.monotonically_increasing_id()), "base")
    terms = disclosure(base.filter(F.greatest(*[F.size(k) for k in KINDS]) > 0), base.select("rid", "text"), scratch, min_docs)

    flagged = join_checked(base.select("rid", F.explode(_words(F.col("text"))).alias("term")), terms.select("term", "level"), "term", max_rows=500_000)
    of_doc = flagged.groupBy("rid").agg(F.collect_set(F.when(F.col("level") == "general", F.col("term"))).alias("t_general"), F.collect_set(F.when(F.col("level") == "removed", F.col("term"))).alias("t_removed"))
    marked = join_checked(base, scratch.write(of_doc, "of-doc"), "rid", "left")
    marked = marked.withColumns({f"t_{x}": F.coalesce(f"t_{x}", F.array().cast("array<string>")) for x in ("general", "removed")})
    marked = marked.withColumns({f"s_{x}": _term_spans(f"t_{x}") for x in ("general", "removed")})
    marked = marked.withColumns({x: _outside(f"s_{x}", F.concat(*KINDS)) for x in ("general", "removed")})

    written = F.concat(*[_written(k, F.col(k)) for k in KINDS])
    extra = F.concat(*[_written(k, F.col(k)) for k in ("general", "removed")])
    return marked.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(F.array_join(written, ","), 256).alias("base_sha256"),
        F.array_join(F.concat(written, extra), ",").alias("spans"),
        _replaced(F.col("text")).alias("sanitised"),
    )
