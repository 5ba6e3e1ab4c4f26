"""Personal data by candidate generation and gradient boosted trees, in DataFrame functions alone.

Generators are regular expressions. Four are the base patterns, whose valid
matches are always reported. The wide ones propose more: addresses written
around, numbers in other groupings, addresses of the newer internet protocol.
Their spans overlap. Each candidate gets features of its format and of the
characters around it. Boosted trees learn from all base
candidates which of them hold up: those whose checksum, octets or number of
digits is right are labelled 1. What these checks read is no feature, so the
trees learn what real data look like and how they are introduced, not the check.
A wide candidate is reported if the trees give it at least the probability from
which on, on candidates of its kind that they have not seen, as many were right
as asked for; a kind without candidates of both labels to calibrate on gets no
wide spans.

All quantifiers over groups are possessive, so long runs of digits or labels
need no stack, and runs are entered at their start only, so time is linear.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .boosting import BoostedTrees, fit_rows
from .common import text_or_empty, written

KINDS = ["email", "ip", "card", "phone"]
_LOCAL = "[A-Za-z0-9._%+-]"
#: name: (kind, pattern, base pattern?, pattern without which there is no match)
GENERATORS: dict[str, tuple[str, str, bool, str]] = {
    "email": ("email", rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", True, "@"),
    "ip": ("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", True, r"[0-9]\.[0-9]"),
    "card": ("card", r"[0-9](?:[\x20-]?[0-9])++", True, "[0-9]"),
    "phone": ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", True, r"\+[0-9]"),
    "email_wide": ("email", rf"(?<!{_LOCAL}){_LOCAL}++\x20?(?:@|\(at\)|\[at\])\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|\(dot\)|\[dot\])\x20?[A-Za-z0-9-]++)++", False, r"@|[(\[]at[)\]]"),
    "ip_wide": ("ip", r"(?<![0-9A-Za-z:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{0,4}){3,7}(?![0-9A-Za-z:])", False, r":[0-9A-Fa-f]{0,4}:"),
    "number_wide": ("phone", r"(?<![0-9A-Za-z.])[(]?[0-9](?:[\x20()./-]{0,2}[0-9])++", False, "[0-9]"),
}
#: What the checks read, the number of digits, their groups' length and the checksum, is left out.
FEATURES = ["letters", "spaces", "dashes", "dots", "brackets", "plus", "at", "zero_first", "groups", "before_space", "before_letter", "before_mark", "after_space", "after_letter", "after_digit", "cue", *(f"is_{k}" for k in KINDS)]


def _found(name: str, text: Column) -> Column:
    """An array of matches with the length of what stands before each and the characters around it."""
    _, pattern, _, gate = GENERATORS[name]
    # split() gives what lies between the matches of extract_all(), in order
    pieces = F.transform(F.split(text, pattern, -1), lambda p: F.struct(F.length(p).alias("n"), F.right(p, F.lit(16)).alias("tail"), F.left(p, F.lit(16)).alias("head")))
    rows = F.arrays_zip(pieces.alias("a"), F.slice(pieces, 2, 1_000_000_000).alias("b"), F.regexp_extract_all(text, F.lit(pattern), 0).alias("m"))
    spans = F.transform(
        rows,
        lambda x, i: F.struct(F.lit(name).alias("generator"), i.alias("at"), x["a"]["n"].alias("gap"), x["a"]["tail"].alias("before"), x["m"].alias("match"), x["b"]["head"].alias("after")),
    )
    kind = "array<struct<generator:string,at:int,gap:int,before:string,match:string,after:string>>"
    return F.when(text.rlike(gate), F.filter(spans, lambda x: x["match"].isNotNull())).otherwise(F.array()).cast(kind)


def _luhn(digits: Column) -> Column:
    """The sum's last digit is 0 when every second digit from the right is doubled (less 9 if over 9)."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(c == "", 0).otherwise(F.try_to_number(c, F.lit("9")).cast("int") * (1 + i % 2)))
    return F.aggregate(each, F.lit(0), lambda s, d: s + d - F.when(d > 9, 9).otherwise(0)) % 10 == 0


def _count(match: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(match, f"[^{pattern}]", ""))


def candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """All generators' candidates with places, validity and features, and a row without match for each text."""
    kind_of_row = "array<struct<generator:string,at:int,gap:int,before:string,match:string,after:string>>"
    none = F.array(F.struct(*(F.lit(None) for _ in range(6)))).cast(kind_of_row)
    found = F.concat(none, *(_found(name, F.col("text")) for name in GENERATORS))
    rows = (
        docs.select("doc_id", F.monotonically_increasing_id().alias("row"), text_or_empty(text).alias("text"))
        .select("doc_id", "row", F.explode(found).alias("c"))
        .select("doc_id", "row", "c.*")
        .repartition("row")
    )
    upto = Window.partitionBy("row", "generator").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    m = F.col("match")
    digits = F.regexp_replace(m, "[^0-9]", "")
    n = F.length(digits)
    octet = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{0,2})"
    kind = reduce(lambda e, g: e.when(F.col("generator") == g, GENERATORS[g][0]), list(GENERATORS)[1:], F.when(F.col("generator") == "email", "email"))
    kind = F.when((F.col("generator") == "number_wide") & (n >= 14), "card").otherwise(kind)
    checksum = F.when(n.between(12, 19), _luhn(digits)).otherwise(F.lit(False))
    valid = (
        F.when(F.col("generator") == "email", F.lit(True))
        .when(F.col("generator") == "ip", m.rlike(rf"\A{octet}(?:\.{octet}){{3}}\z"))
        .when(F.col("generator") == "card", n.between(14, 19) & checksum)
        .when(F.col("generator") == "phone", n.between(10, 15))
        .otherwise(F.lit(False))
    )
    before, after = F.right("before", F.lit(1)), F.left("after", F.lit(1))
    flags = {
        "letters": _count(m, "A-Za-z"), "spaces": _count(m, "\\x20"), "dashes": _count(m, "-"), "dots": _count(m, "."), "brackets": _count(m, "()\\[\\]"),
        "plus": m.startswith("+"), "at": m.contains("@"), "zero_first": digits.startswith("0"), "groups": F.size(F.split(m, "[^0-9A-Za-z]+")),
        "before_space": before.rlike(r"\s") | (before == ""), "before_letter": before.rlike(r"\p{L}"), "before_mark": before.rlike("[\"'=/#$]"), "after_space": after.rlike(r"\s") | (after == ""),
        "after_letter": after.rlike(r"\p{L}"), "after_digit": after.rlike("[0-9]"), "cue": F.lower("before").rlike("tel|phone|call|mail|card|visa|addr|ip|contact"),
    }
    placed = rows.withColumn("end", F.sum(F.col("gap") + F.length("match")).over(upto)).withColumns({"start": F.col("end") - F.length("match"), "kind": kind, "valid": F.coalesce(valid, F.lit(False)), "base": F.col("generator").isin([g for g, x in GENERATORS.items() if x[2]])})
    features = {k: F.coalesce(v.cast("double"), F.lit(0.0)) for k, v in flags.items()} | {f"is_{k}": F.coalesce((kind == k).cast("double"), F.lit(0.0)) for k in KINDS}
    return placed.select("doc_id", "row", "start", "end", "kind", "base", "valid", "match", n.alias("digits"), *(v.alias(f"f_{k}") for k, v in features.items()))


@dataclass
class Trained:
    trees: BoostedTrees
    #: The least probability of a wide span of a kind; 2: none.
    thresholds: dict[str, float]
    #: Of held-back base candidates of a kind: how many, the share of valid ones, and of these the share above the threshold.
    measured: dict[str, tuple[int, float, float]]


def train(found: DataFrame, precision: float = 0.995) -> Trained:
    """Trees and each kind's threshold, from all candidates of the base patterns.

    A hash of the match puts three of five into training and the others into
    calibration, so equal matches are on one side; each place where a match stands
    counts. Candidates that look the same are counted together, and trees and
    thresholds follow from these counts. Short digit runs are no candidates for
    cards.
    """
    usable = found.where("match IS NOT NULL AND base AND (kind <> 'card' OR digits >= 7)")
    later = F.pmod(F.xxhash64("match"), F.lit(5)) >= 3
    looks = usable.groupBy(later.alias("later"), "kind", *(F.col(f"f_{f}").alias(f) for f in FEATURES))
    looks = written(looks.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("valid").cast("long")).alias("y")), "pii-looks")
    model = fit_rows(FEATURES, looks.where("NOT later"))
    scored = looks.where("later").select("kind", model.probability({f: F.col(f) for f in FEATURES}).alias("p"), "n", "y")
    down = Window.partitionBy("kind").orderBy(F.desc("p"))
    above = scored.groupBy("kind", "p").agg(F.sum("n").alias("n"), F.sum("y").alias("y")).withColumns({"so_far": F.sum("n").over(down), "right": F.sum("y").over(down)})
    good = F.when(F.col("right") / F.col("so_far") >= precision, F.struct("p", "right"))
    thresholds, measured = dict.fromkeys(KINDS, 2.0), dict.fromkeys(KINDS, (0, 0.0, 0.0))
    for r in above.groupBy("kind").agg(F.sum("n").alias("n"), F.sum("y").alias("y"), F.min(good).alias("least")).collect():
        usual = r.least if r.least and 0 < r.y < r.n else None
        if usual:
            thresholds[r.kind] = usual.p
        measured[r.kind] = (r.n, r.y / r.n, usual.right / r.y if usual else 0.0)
    return Trained(model, thresholds, measured)


def find(docs: DataFrame, text: str = "text", precision: float = 0.995) -> DataFrame:
    """One row per reported span: ``doc_id, row, kind, start, end, base, score, match``.

    Places are code points of the text, the end exclusive. ``row`` tells rows of
    equal doc_id apart; each has one more row without a span. A wide
    candidate that overlaps a base span is not reported, nor one that overlaps a
    wide candidate that starts before it.
    """
    found = written(candidates(docs, text), "pii-candidates")
    model = train(found, precision)
    thresholds = model.thresholds
    score = model.trees.probability({f: F.col(f"f_{f}") for f in FEATURES})
    least = reduce(lambda e, k: e.when(F.col("kind") == k, thresholds[k]), KINDS[1:], F.when(F.col("kind") == "email", thresholds["email"]))
    enough = F.when(F.col("kind").isin("phone", "card"), F.col("digits").between(10, 19)).otherwise(F.lit(True))
    taken = found.select("doc_id", "row", "kind", "start", "end", "base", "valid", "match", score.alias("score"), ((score >= least) & enough).alias("chosen"))
    taken = taken.where("match IS NULL OR (base AND valid) OR (NOT base AND chosen)")
    order = Window.partitionBy("row").orderBy("start", "end", "kind")
    solid = F.col("base") & F.col("valid")
    taken = taken.withColumns(
        {
            "_until": F.max(F.when(solid, F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, -1)),
            "_from": F.min(F.when(solid, F.col("start"))).over(order.rowsBetween(1, Window.unboundedFollowing)),
            "_wide": F.max(F.when(~F.col("base"), F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, -1)),
        }
    )
    clash = (F.col("_until") > F.col("start")) | (F.col("_from") < F.col("end")) | (F.col("_wide") > F.col("start"))
    kept = taken.where(F.col("match").isNull() | solid | ~F.coalesce(clash, F.lit(False)))
    return kept.select("doc_id", "row", "kind", "start", "end", "base", "score", "match")


def digest(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """One row per row of ``docs``: counts of the base spans by kind, ``base_sha256``, ``spans`` and ``has_pii``.

    ``base_sha256`` is that of the base spans as ``kind:start:end``, by start and
    then in the order of :data:`KINDS`, joined with commas; ``spans`` has all, and
    ``has_pii`` tells whether there are any. Long texts are searched whole.
    Null and empty texts have no spans (the digest is that of the empty string).
    Equal texts have equal spans. Other columns are not read; an empty table
    gives no rows.
    """
    spans = find(docs, text, **options)
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    span = F.struct("start", rank.alias("rank"), "end", "kind", "base")
    per_row = spans.groupBy("row", "doc_id").agg(F.array_sort(F.collect_list(F.when(F.col("kind").isNotNull(), span))).alias("s"))

    def joined(array: Column) -> Column:
        return F.array_join(F.transform(array, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    base = F.filter("s", lambda x: x["base"])
    count = lambda k: F.size(F.filter("s", lambda x: x["base"] & (x["kind"] == k))).cast("long").alias(f"n_{k}")
    return per_row.select("doc_id", *(count(k) for k in KINDS), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("s")).alias("spans"), (F.size("s") > 0).alias("has_pii"))


def redact(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """``doc_id`` and the text with every reported span replaced by its kind in angle brackets."""
    numbered = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), F.col(text).alias("text"))
    spans = find(docs, text, **options).where("kind IS NOT NULL").groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "end", "kind"))).alias("s"))
    merged = F.aggregate(
        F.coalesce("s", F.array()),
        F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out")),
        lambda a, x: F.when(x["start"] < a["at"], a).otherwise(F.struct(x["end"].cast("long").alias("at"), F.concat(a["out"], F.substring(F.col("text"), (a["at"] + 1).cast("int"), (x["start"] - a["at"]).cast("int")), F.lit("<"), x["kind"], F.lit(">")).alias("out"))),
    )
    return numbered.join(spans, "row", "left").withColumn("m", merged).select("doc_id", F.concat("m.out", F.substring(F.col("text"), (F.col("m.at") + 1).cast("int"), F.lit(1_000_000_000))).alias("text"))
