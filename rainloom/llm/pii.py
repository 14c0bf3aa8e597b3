"""Personal data by patterns and by bootstrapped contexts, in DataFrame operations only.

Base patterns find e-mail, internet, card and phone numbers in every text. Their occurrences are the seeds: the
word and the two words before an identifier are lexical patterns, and patterns and instances (the strings they
introduce) form a bipartite graph. A round gives a pattern the share of its uses that introduce known instances,
and an instance the chance that at least one of its sure patterns is right. An instance found in one round is known
in the next, where it can make patterns sure that introduce no seed; rounds end when no pattern becomes sure.
Sure patterns mark the identifiers they introduce, which no base pattern matches.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from rainloom.llm.common import query, table, text_or_empty
from rainloom.session import cut_lineage

KINDS = ("email", "ip", "card", "phone")
#: The contract's patterns with possessive loops, which cannot overflow the stack on long runs. A search may only begin at the left end of a
#: run or where the last match ended; from any other place in a run it would fail or start further left.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: A run of identifier characters with a digit or an at sign in it.
IDENTIFIER = r"(?<![A-Za-z0-9@._%+#/-])[A-Za-z._%+#/-]*+[0-9@][A-Za-z0-9@._%+#/-]*[A-Za-z0-9]"
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
SPAN = "struct<start:int,end:int,left:array<string>,m:string>"
#: Distinct known instances and share of uses that make a pattern sure, turns of a hot pattern, rows of a broadcast, code points of a context.
MIN_KNOWN, MIN_CONFIDENCE, SALTS, BROADCAST_ROWS, CONTEXT = 5, 0.5, 16, 100_000, 64


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return m.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    if kind == "card":
        return F.length(digits(m)).between(16, 19) & F.call_function("luhn_check", digits(m))
    if kind == "phone":
        return F.length(digits(m)).between(8, 15)
    return F.lit(True)


def plausible(m: Column) -> Column:
    """The kinds that a string beyond the base patterns may be, by its shape."""
    n = F.length(digits(m))
    return F.array_compact(F.array(
        F.when(m.contains("@"), "email"), F.when(m.rlike(r"^[0-9]+(?:\.[0-9]+){3}$"), "ip"),
        F.when(m.rlike("^[0-9-]+$") & n.between(12, 19), "card"), F.when(m.rlike("^[0-9+.-]+$") & n.between(7, 15), "phone")))


def contexts(before: Column, first: Column) -> Column:
    """The word and the two words that end `before`, in lower case with digits alike, each only where it begins inside: `first` tells that the text does."""
    tail = F.substring(F.when(first, F.concat(F.lit(" "), before)).otherwise(before), -CONTEXT, CONTEXT)
    each = [F.regexp_extract(tail, rf"\s({words})\s*$", 1) for words in (r"\S+", r"\S+\s+\S+")]
    return F.transform(F.filter(F.array(*each), lambda w: w != ""), lambda w: F.regexp_replace(shape(w), r"\s+", " "))


def shape(word: Column) -> Column:
    return F.regexp_replace(F.lower(word), "[0-9]", "0")


def found(text: Column, pattern: str, keep) -> Column:
    """Spans of a pattern that pass keep, by start: the pieces between matches give the places, as code points."""
    both = F.arrays_zip(F.split(text, pattern, -1).alias("p"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"))
    none = F.array().cast(f"array<{SPAN}>")

    def step(s, x):
        start = s["at"] + F.length(x["p"])
        end = start + F.coalesce(F.length(x["m"]), F.lit(0))
        span = F.struct(start.alias("start"), end.alias("end"), contexts(x["p"], s["at"] == 0).alias("left"), x["m"].alias("m"))
        return F.struct(end.alias("at"), F.when(x["m"].isNotNull() & keep(x["m"]), F.concat(s["got"], F.array(span))).otherwise(s["got"]).alias("got"))

    zero = F.struct(F.lit(0).alias("at"), none.alias("got"))
    return F.when(text.rlike(pattern), F.aggregate(both, zero, step, lambda s: s["got"])).otherwise(none)


def base_spans(text: Column) -> dict[str, Column]:
    none = F.array().cast(f"array<{SPAN}>")
    some = {"email": text.contains("@"), "phone": text.contains("+")}
    return {k: F.when(some.get(k, text.rlike("[0-9]")), found(text, PATTERNS[k], partial(valid, k))).otherwise(none) for k in KINDS}


def scan(docs: DataFrame) -> DataFrame:
    """Base spans and identifier-like runs of each text in one pass, without the text: key, doc_id, a column for each kind, other.

    The key is two hashes of (doc_id, text); rows that repeat both share it and have equal spans.
    """
    d = docs.select("doc_id", text_or_empty().alias("text"))
    t = F.col("text")
    other = F.when(t.rlike("[0-9@]"), found(t, IDENTIFIER, lambda m: F.size(plausible(m)) > 0)).otherwise(F.array().cast(f"array<{SPAN}>"))
    return d.select("doc_id", *key(), *(c.alias(k) for k, c in base_spans(t).items()), other.alias("other"))


def key() -> list[Column]:
    return [F.xxhash64("doc_id", "text").alias("_k1"), F.hash("text", F.length("text")).alias("_k2")]


def occurrences(scanned: DataFrame) -> DataFrame:
    """A row for each seed, and for each plausible kind of each identifier that overlaps no base span."""
    one = scanned.dropDuplicates(["_k1", "_k2"]).where(" or ".join(f"size({k}) > 0" for k in (*KINDS, "other")))
    tagged = F.concat(*(tag(k, k != "other") for k in (*KINDS, "other")))
    rows = one.select("_k1", "_k2", F.explode(tagged).alias("x")).select("_k1", "_k2", "x.*")
    # An identifier overlaps a base span if one that begins before it ends inside or behind it, or one that ends behind it begins inside.
    w = W.partitionBy("_k1", "_k2").orderBy("start", F.desc("seed"))
    upto = F.max(F.when(F.col("seed") == 1, F.col("end"))).over(w.rowsBetween(W.unboundedPreceding, 0))
    after = F.min(F.when(F.col("seed") == 1, F.col("start"))).over(w.rowsBetween(1, W.unboundedFollowing))
    rows = rows.withColumn("_upto", upto).withColumn("_after", after)
    clear = (F.col("seed") == 1) | ((F.coalesce("_upto", F.lit(0)) <= F.col("start")) & (F.coalesce("_after", F.lit(2**31 - 1)) >= F.col("end")))
    return rows.where(clear).select("_k1", "_k2", F.explode("kinds").alias("kind"), "start", "end", "left", "m", "seed")


def tag(kind: str, seed: bool) -> Column:
    def row(s):
        kinds = F.array(F.lit(kind)) if seed else plausible(s["m"])
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), s["left"].alias("left"), s["m"].alias("m"), F.lit(int(seed)).alias("seed"), kinds.alias("kinds"))

    return F.transform(kind, row)


def use_counts(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """How often each word or pair of words in `patterns` stands in the texts that can hold an identifier."""
    words = F.col("_words")
    each = docs.where(text_or_empty().rlike("[0-9@]")).select(F.split(shape(text_or_empty()), r"\s+").alias("_words"))
    pairs = F.transform(words, lambda w, i: F.array(w, F.concat(F.get(words, i - 1), F.lit(" "), w)))
    each = each.select(F.explode(pairs).alias("_p")).select(F.explode("_p").alias("left"))
    return each.join(patterns, "left").groupBy("left").agg(F.count("*").alias("n_use"))


def salted(patterns: DataFrame) -> DataFrame:
    return patterns.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def graph(docs: DataFrame, occ: DataFrame) -> DataFrame:
    """The sure patterns: kind, left, confidence.

    A pattern is sure when it introduces at least MIN_KNOWN distinct known instances and its confidence, the sum of
    their scores by use over all uses of its words and one more, reaches MIN_CONFIDENCE. Seeds score 1, others the
    chance that one of their sure patterns is right. Scores only grow, so sure patterns stay sure and the rounds end.
    """
    uses = occ.select("kind", F.explode("left").alias("left"), "m", "seed")
    edges = cut_lineage(uses.groupBy("kind", "left", "m").agg(F.count("*").alias("n"), F.max("seed").cast("double").alias("score")))
    patterns = cut_lineage(edges.groupBy("kind", "left").agg(F.count("*").alias("instances"), F.sum("n").alias("n_edge")).where(F.col("instances") >= MIN_KNOWN))
    counted = use_counts(docs, patterns.select("left").distinct())
    patterns = patterns.join(counted, "left", "left").withColumn("total", F.greatest(F.coalesce("n_use", F.lit(0)), F.col("n_edge")) + 1)
    # What cannot reach the threshold even if all its instances were right leaves the graph, and with it the common words.
    patterns = cut_lineage(patterns.where(F.col("n_edge") >= MIN_CONFIDENCE * F.col("total")).select("kind", "left", "total"))
    salt = F.pmod(F.xxhash64("m"), F.lit(SALTS)).cast("int")
    live = cut_lineage(edges.withColumn("_salt", salt).join(salted(patterns), ["kind", "left", "_salt"]))
    n_sure = 0
    while True:
        share = F.round(F.sum(F.col("n") * F.col("score")) / F.max("total"), 9)
        scored = live.groupBy("kind", "left").agg(share.alias("confidence"), F.count_if(F.col("score") > 0).alias("known"))
        sure = cut_lineage(scored.where((F.col("known") >= MIN_KNOWN) & (F.col("confidence") >= MIN_CONFIDENCE)).select("kind", "left", "confidence"))
        n = sure.count()
        if n == n_sure:
            return sure
        n_sure = n
        seen = live.where("score < 1").join(salted(sure), ["kind", "left", "_salt"])
        belief = seen.groupBy("kind", "m").agg((1 - F.exp(F.sum(F.log1p(-F.col("confidence"))))).alias("belief"))
        live = cut_lineage(live.join(belief, ["kind", "m"], "left").withColumn("score", F.greatest("score", "belief")).drop("belief"))


def discovered(docs: DataFrame, scanned: DataFrame) -> DataFrame:
    """Spans that only their context gives away, as one array to a key: kind, start, end, m. A span with several kinds keeps the surest."""
    occ = cut_lineage(occurrences(scanned))
    hit = occ.where("seed = 0").withColumn("left", F.explode("left")).join(graph(docs, occ), ["kind", "left"])
    best = hit.groupBy("_k1", "_k2", "start", "end").agg(F.min(F.struct((-F.col("confidence")).alias("c"), "kind", "m")).alias("b"))
    return best.groupBy("_k1", "_k2").agg(F.sort_array(F.collect_list(F.struct(F.col("b.kind").alias("kind"), "start", "end", F.col("b.m").alias("m")))).alias("extra"))


def spans(docs: DataFrame) -> DataFrame:
    """For each row of documents: key, doc_id, an array of spans for each kind, and `extra`, the spans found by context (null: none).

    A null text is empty. Repeated rows give equal rows; an empty table gives none.
    """
    s = cut_lineage(scan(docs))
    return s.join(discovered(docs, s), ["_k1", "_k2"], "left").drop("other")


def listed(parts: list[Column]) -> Column:
    return F.array_join(F.concat(*parts), ",")


def has_kind(kind: str, span: Column) -> Column:
    return span["kind"] == kind


def named(col, kind: Column) -> Column:
    return F.transform(col, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), kind.alias("kind")))


def written(kind: str, col) -> Column:
    return F.transform(col, lambda s: F.concat_ws(":", F.lit(kind), s["start"], s["end"]))


@query("op3_bootstrapped_pii")
def bootstrapped_pii(spark, sf):
    """Base spans of every document, and all spans with those found by context."""
    s = spans(table(spark, sf, "documents"))
    none = F.array().cast(f"array<{SPAN}>")
    extra = F.coalesce("extra", F.array().cast("array<struct<kind:string,start:int,end:int,m:string>>"))
    all_of = {k: F.array_sort(F.concat(named(k, F.lit(k)), named(F.filter(extra, partial(has_kind, k)), F.lit(k)))) for k in KINDS}
    return s.select("doc_id", *(F.size(F.coalesce(k, none)).cast("long").alias(f"n_{k}") for k in KINDS),
                    F.sha2(listed([written(k, F.col(k)) for k in KINDS]).cast("binary"), 256).alias("base_sha256"),
                    listed([written(k, c) for k, c in all_of.items()]).alias("spans"), F.size(extra).cast("long").alias("n_by_context"))


def masked(docs: DataFrame) -> DataFrame:
    """Documents with every span replaced by its kind in brackets; overlapping spans become one, named by the first.

    Other columns stay. Up to BROADCAST_ROWS texts with spans are marked by a broadcast, more by a shuffled join.
    """
    s = spans(docs)
    none = F.array().cast("array<struct<start:int,end:int,kind:string>>")
    extra = F.coalesce(F.transform("extra", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))), none)
    every = F.concat(*(named(k, F.lit(k)) for k in KINDS), extra)
    marks = cut_lineage(s.select("_k1", "_k2", F.array_sort(every).alias("_marks")).where(F.size("_marks") > 0).dropDuplicates(["_k1", "_k2"]))
    keyed = docs.select("doc_id", text_or_empty().alias("text"), F.struct("*").alias("_row")).select("text", "_row", *key())
    text = F.col("text")

    def step(a, x):
        fresh = x["start"] >= a["at"]
        gap = F.substring(text, a["at"] + 1, x["start"] - a["at"])
        mark = F.concat(gap, F.lit("["), F.upper(x["kind"]), F.lit("]"))
        return F.struct(F.greatest(a["at"], x["end"]).alias("at"), F.when(fresh, F.concat(a["out"], F.array(mark))).otherwise(a["out"]).alias("out"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    redacted = F.aggregate("_marks", zero, step, lambda a: F.concat(F.array_join(a["out"], ""), F.substring(text, a["at"] + 1, F.length(text))))
    few = F.broadcast(marks) if marks.count() <= BROADCAST_ROWS else marks
    out = keyed.join(few, ["_k1", "_k2"], "left").withColumn("_text", F.when(F.col("_marks").isNull(), F.col("_row.text")).otherwise(redacted))
    return out.select(*(F.col("_text").alias("text") if c == "text" else F.col("_row")[c].alias(c) for c in docs.columns))
