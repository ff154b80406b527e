"""Personal data: base patterns as seeds, and bootstrapped contextual extraction; SQL functions only.

Base matches seed the bootstrap. Tokens with a digit or an @ are instances; the words around
an instance are its patterns. In each round a pattern scores, for a kind, the sum of the scores of its distinct
instances over their number; patterns of SUPPORT known instances that score CONFIDENCE or more are confident, and
instances in them are known from then on, with the best of their patterns' scores, damped; seeds score 1. Rounds end when no
instance is new and the scores have settled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_table, table

#: Kinds in their order, the pattern, and a plain test that texts with a match pass. A match that starts within a run of the
#: first class can only follow the match before it (\G), so look-behind keeps long runs linear; the possessive loops change no match.
KINDS = {
    "email": (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    "ip": (r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]"),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", r"[0-9][\x20-]?[0-9]"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]"),
}
_B = r"\x20\x09-\x0D"
TOKEN = rf"(?<![^{_B}])[^{_B}0-9@]*+[0-9@][^{_B}]*+"
#: Known instances that a pattern needs, its least score, and the share of it that an instance gets.
SUPPORT, CONFIDENCE, DAMPING = 5, 0.8, 0.9
#: Share by which all scores together must still grow for another round.
SETTLED = 1e-3
#: What stands for a neighbour that has a digit or an @ itself, and for the ends of a text.
NUMBER, START, END = "<num>", "<s>", "</s>"


def cut(kind: str, pattern: str, test: str, around: bool = False) -> Column:
    """Array of (kind, match, gap before it, words to its left, first word to its right) over the text; empty where the test fails.

    The words are told if asked for; of any length, from the whole gaps.
    """
    found = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
    gaps = F.split("text", pattern, -1)
    none = F.lit(None).cast("string")

    def item(m: Column, i: Column) -> Column:
        gap, after = F.get(gaps, i), F.get(gaps, i + 1)
        one = F.lower(F.regexp_extract(gap, rf"(?:^|[{_B}])([^{_B}]++)[{_B}]*+$", 1))
        two = F.lower(F.regexp_extract(gap, rf"(?:^|[{_B}])([^{_B}]++[{_B}]++[^{_B}]++)[{_B}]*+$", 1))
        right = F.lower(F.regexp_extract(after, rf"^[{_B}]*+([^{_B}]++)", 1))
        one = F.when(one != "", one).otherwise(F.when(i == 0, START).otherwise(NUMBER))
        right = F.when(right != "", right).otherwise(F.when(i + 1 == F.size(found), END).otherwise(NUMBER))
        words = (one, F.when(two != "", two), right) if around else (none, none, none)
        return F.struct(F.lit(kind).alias("kind"), m.alias("match"), gap.alias("gap"), *[w.alias(n) for w, n in zip(words, ("one", "two", "right"))])

    return F.when(F.col("text").rlike(test), F.transform(found, item)).otherwise(F.array().cast("array<struct<kind:string,match:string,gap:string,one:string,two:string,right:string>>"))


def placed(texts: DataFrame, found: Column) -> DataFrame:
    """(doc_id, h, kind, match, one, two, right, start, end) of the items of found, in code points, from the lengths of gaps and matches.

    A text is told by its doc_id and h; rows that repeat both are one.
    """
    rows = texts.where(F.col("text").rlike("[0-9@]")).select("doc_id", "h", F.posexplode(found).alias("pos", "x"))
    rows = rows.select("doc_id", "h", "pos", "x.kind", "x.match", F.length("x.gap").alias("gap"), "x.one", "x.two", "x.right")
    rows = rows.repartition("doc_id", "h").dropDuplicates(["doc_id", "h", "kind", "pos"])
    w = Window.partitionBy("doc_id", "h", "kind").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.length("match")).over(w)
    return rows.withColumn("end", end).withColumn("start", F.col("end") - F.length("match"))


def luhn(digits: Column) -> Column:
    padded = F.lpad(digits, 20, "0")
    total = F.lit(0)
    for i in range(20):
        d = F.substring(padded, 20 - i, 1).cast("int")
        total = total + (F.when(d > 4, 2 * d - 9).otherwise(2 * d) if i % 2 else d)
    return total % 10 == 0


def holds(kind: Column, match: Column) -> Column:
    """The tests that a base match must pass."""
    parts = F.transform(F.split(match, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", ""))
    small = F.forall(parts, lambda p: (F.length(p) <= 3) & (F.when(F.length(p) <= 3, p).otherwise(F.lit("999")).cast("int") <= 255))
    digits = F.regexp_replace(match, "[^0-9]", "")
    n = F.length(digits)
    return F.when(kind == "ip", small).when(kind == "card", F.when(n.between(16, 19), luhn(digits)).otherwise(False)).when(kind == "phone", n.between(8, 15)).otherwise(F.lit(True))


def base_spans(texts: DataFrame) -> DataFrame:
    """(doc_id, h, kind, start, end) of the base matches that hold."""
    rows = placed(texts, F.concat(*[cut(k, p, t) for k, (p, t) in KINDS.items()]))
    return rows.where(holds(F.col("kind"), F.col("match"))).select("doc_id", "h", "kind", "start", "end")


def instances(texts: DataFrame, base: DataFrame) -> DataFrame:
    """(doc_id, h, value, start, end, seed, patterns) of the tokens with a digit or an @ that don't lie inside a base span."""
    rows = placed(texts, cut("", TOKEN, "[0-9@]", True))
    head = F.length(F.regexp_extract("match", r"^[\"'(\[<]*+", 0))
    value = F.regexp_replace(F.regexp_replace("match", r"^[\"'(\[<]*+", ""), r"(?<![.,;:!?)\]>\"'])[.,;:!?)\]>\"']++$", "")
    rows = rows.withColumn("value", value).withColumn("start", F.col("start") + head).withColumn("end", F.col("start") + F.length("value"))
    some = F.array(F.concat(F.lit("l:"), "one"), F.concat(F.lit("2:"), "two"), F.concat(F.lit("r:"), "right"), F.concat(F.lit("b:"), "one", F.lit(" "), "right"))
    tokens = rows.select("doc_id", "h", "start", "end", "value", F.filter(some, lambda p: p.isNotNull()).alias("patterns"), F.lit(None).cast("string").alias("kind"))
    spans = base.select("doc_id", "h", "start", "end", F.lit(None).cast("string").alias("value"), F.lit(None).cast("array<string>").alias("patterns"), "kind")
    w = Window.partitionBy("doc_id", "h").orderBy("start")
    own = F.when(F.col("kind").isNotNull(), F.col("end"))
    both = tokens.union(spans).withColumn("seed", F.max("kind").over(w.rangeBetween(0, 0))).withColumn("past", F.max(own).over(w.rangeBetween(Window.unboundedPreceding, -1)))
    return both.where("value is not null and value <> '' and (past is null or past <= start)").select("doc_id", "h", "value", "start", "end", "seed", "patterns")


def _mass(scores: DataFrame) -> tuple[int, float]:
    r = scores.agg(F.count("*"), F.coalesce(F.sum("score"), F.lit(0.0))).first()
    return r[0], r[1]


def confident_patterns(found: DataFrame) -> DataFrame:
    """(pattern, kind) of the confident patterns once a round over the pattern-instance graph adds no instance, nor much to the scores."""
    edges = table(found.select(F.explode("patterns").alias("pattern"), "value").distinct(), "edges")
    sizes = table(edges.groupBy("pattern").agg(F.count("*").alias("all")).where(F.col("all") >= SUPPORT), "sizes")
    seeds = found.where("seed is not null").select("value", F.col("seed").alias("kind")).distinct().withColumn("score", F.lit(1.0))
    scores = table(seeds, "scores")
    before = _mass(scores)
    while True:
        mass = edges.join(scores.hint("merge"), "value").groupBy("pattern", "kind").agg(F.sum("score").alias("s"), F.count("*").alias("n")).where(F.col("n") >= SUPPORT)
        rated = mass.join(sizes.hint("merge"), "pattern").select("pattern", "kind", (F.col("s") / F.col("all")).alias("score")).where(F.col("score") >= CONFIDENCE)
        rated = table(rated, "rated")
        more = edges.join(rated.hint("merge"), "pattern").select("value", "kind", (F.col("score") * DAMPING).alias("score"))
        # What is known stays known and scores only grow, up to 1, so that rounds end.
        after = table(more.union(scores.select("value", "kind", "score")).groupBy("value", "kind").agg(F.max("score").alias("score")), "scores")
        now = _mass(after)
        drop_table(scores)
        if now[0] == before[0] and now[1] - before[1] <= SETTLED * now[1]:
            drop_table(after)
            return rated.select("pattern", "kind")
        scores, before = after, now


def personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans), a row for each row of docs.

    The counts and base_sha256 are of base matches; spans has those and what the bootstrap found,
    as kind:start:end by kind in the order of KINDS, then start. Offsets are code points, end
    exclusive. A token found as two kinds gives a span of each. docs: doc_id and text; other columns are ignored. Null or empty texts have no spans.
    Rows that repeat a doc_id, or have none, are told apart by their texts; equal rows get equal
    results. An empty table gives an empty table.
    """
    texts = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("h"))
    base = table(base_spans(texts), "base")
    seen = table(instances(texts, base), "instances")
    known = confident_patterns(seen)
    new = seen.where("seed is null").select("doc_id", "h", "start", "end", F.explode("patterns").alias("pattern")).join(known.hint("merge"), "pattern")
    both = base.select("doc_id", "h", "kind", "start", "end", F.lit(True).alias("base")).union(new.select("doc_id", "h", "kind", "start", "end", F.lit(False))).distinct()
    order = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))])
    item = F.struct(F.element_at(order, F.col("kind")).alias("o"), "start", "end", "kind", "base")
    per = both.groupBy("doc_id", "h").agg(F.array_sort(F.collect_list(item)).alias("spans"))

    def told(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("h"))
    out = rows.join(per, rows["doc_id"].eqNullSafe(per["doc_id"]) & (rows["h"] == per["h"]), "left").select(rows["doc_id"], F.coalesce(per["spans"], F.array().cast(per.schema["spans"].dataType)).alias("a"))
    own = F.filter("a", lambda s: s["base"])

    def of(kind: str):
        return lambda s: s["kind"] == kind

    counts = [F.size(F.filter(own, of(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return out.select("doc_id", *counts, F.sha2(told(own).cast("binary"), 256).alias("base_sha256"), told(F.col("a")).alias("spans"))
