"""Personal data: high-recall span generators, boosted trees over format and context, calibrated selection.

Everything on the rows is DataFrame expressions. A generator is a pattern; its matches' places come from
splitting the text on the pattern and adding up lengths, so that no row is exploded or shuffled; a text without a pattern's core is read
once for it. Matches that pass a base kind's check are always selected. The other candidates are
scored by boosted trees, which are turned into a column expression, and selected above a threshold that
calibration on held-out documents puts at MIN_PRECISION.

Two views of a candidate are kept apart. The weak label looks at its value alone: whether a check sum, ranges of numbers or the
spread of its letters speak for a real one. The trees never see these; they see kind, format (length, digits, groups, quotes) and
context (cue words, assignment, neighbours), and so learn where and in which form real values stand. They are fitted on counts:
candidates of at most SAMPLE_DOCS documents (chosen by hash, one a document id, written to the shared folder first), grouped by features
and label in Spark; this table's size is bounded by the features' ranges. Half of the documents calibrate.

The patterns are those of the base kinds with possessive repeats, which keeps matching linear on long
texts; a match starts where a run starts or where the match before ended, as a leftmost search would have it. Spans are gathered in
pieces of PIECE, so that texts of many matches stay near linear too.

Defined cases: null and empty texts have no spans and the digest of the empty string; null ids and repeated rows are each reported, but train once or not at all;
very long texts are read whole, and texts of many matches too, in near linear time; candidates of equal score are selected or left together; without candidates in the sample only base spans are selected;
an empty table gives an empty result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkfold.llm.common import Scratch, hash_sample

SAMPLE_DOCS, MIN_PRECISION, ROUNDS, SHRINK, PIECE = 20_000, 0.95, 12, 0.5, 256
#: Base kinds in the order of reports, then the added ones.
BASE = ("email", "ip", "card", "phone")
ADDED = ("secret", "phone_local", "card_like")
FEATURES = ("kind", "digits", "groups", "size", "cue", "assigned", "quoted", "apart")
_RUN = r"(?:(?<![0-9])|\G)"
#: A generator's pattern, and a core that every text with a candidate of it has.
GENERATORS = {
    "email": (r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    "ip": (_RUN + r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"),
    "card": (_RUN + r"(?=[0-9][\x20-]?[0-9])[0-9]++(?:[\x20-][0-9]++)*+", r"[0-9](?:[\x20-]?[0-9]){12}"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]"),
    "secret": (r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{24,}+", r"[0-9A-Fa-f]{24}"),
    "phone_local": (r"(?<![0-9A-Za-z+])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[.-][0-9]{4}(?![0-9])", r"[0-9]{3}\)?[\x20.-][0-9]{3}[.-][0-9]{4}"),
}
CUE = r"(?i)(?:token|key|secret|passw\w*+|tel|phone|call|mobile|mail|card|visa|ip|addr\w*+)\W*+$"


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        doubled = F.when((n - i) % 2 == 1, d * 2).otherwise(d)
        return total + doubled - F.when(doubled > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _octets(text: Column) -> Column:
    """Whether all dotted parts are at most 255; leading zeros don't count."""
    return F.forall(F.split(text, r"\."), lambda p: (F.length(F.ltrim(F.lit("0"), p)) <= 3) & (F.coalesce(F.right(p, F.lit(3)).cast("int"), F.lit(0)) <= 255))


def _spread(m: Column) -> Column:
    """Whether a hexadecimal value has at least ten different digits, letters and numerals among them, and none four times in a row."""
    low = F.lower(m)
    kinds = F.size(F.array_distinct(F.split(low, "")))
    return (kinds >= 10) & low.rlike("[a-f]") & low.rlike("[0-9]") & ~low.rlike(r"(.)\1\1\1")


def _facts(kind: str, m: Column, left: Column, right: Column) -> tuple[Column, Column, list[Column]]:
    """(kept as a candidate, passes as a span of the base kind, [kind, label from the value, features of format and context])."""
    digits = _digits(m)
    n = F.length(digits)
    no = F.lit(False)
    apart = ~left.rlike(r"[A-Za-z0-9]$") & ~right.rlike(r"^[A-Za-z0-9]")
    name = F.lit(kind)
    if kind == "email":
        kept = ok = label = F.lit(True)
    elif kind == "ip":
        kept = F.lit(True)
        ok = label = _octets(m)
    elif kind == "card":
        kept = n.between(13, 19)
        label = F.when(kept, luhn(digits)).otherwise(no)
        ok, name = label & (n >= 16), F.when(n < 16, "card_like").otherwise("card")
        label = label & digits.rlike("^[3-6]")
    elif kind == "phone":
        kept, ok = F.lit(True), n.between(8, 15)
        label = ok
    elif kind == "secret":
        kept, ok, label = F.lit(True), no, _spread(m)
    else:  # a local number: area and exchange start above 1, the last four differ
        kept, ok, label = F.lit(True), no, digits.rlike(r"^[2-9][0-9]{2}[2-9][0-9]{2}") & ~digits.rlike(r"([0-9])\1\1\1$")
    code = F.lit(list(GENERATORS).index(kind))
    bit = lambda c: c.cast("int")
    groups = F.size(F.split(m, "[^0-9A-Za-z]+"))
    quoted = left.rlike("[\"']$") & right.rlike("^[\"']")
    values = (code, F.least(n, F.lit(20)), F.least(groups, F.lit(8)), F.least(F.floor(F.length(m) / 4).cast("int"), F.lit(16)), bit(left.rlike(CUE)), bit(left.rlike(r"[=:]\s*+[\"']?$")), bit(quoted), bit(apart))
    return kept, ok, [name.alias("kind"), bit(label).alias("label"), F.array(*[v.cast("int") for v in values]).alias("features")]


SPAN = "struct<kind:string,start:int,end:int,ok:boolean,label:int,features:array<int>>"
_NO_SPANS = f"array<{SPAN}>"


def _spans(found: Column, parts: Column, kind: str) -> Column:
    """The candidates of one generator, in order: array of SPAN. found: its matches; parts: what lies between them."""
    none = F.array().cast(_NO_SPANS)

    def fold(acc: Column, i: Column) -> Column:
        m, before = F.get(acc["found"], i), F.get(acc["parts"], i)
        start = acc["at"] + F.length(before)
        end = start + F.length(m)
        kept, ok, about = _facts(kind, m, F.right(before, F.lit(24)), F.left(F.get(acc["parts"], i + 1), F.lit(1)))
        span = F.struct(about[0], start.alias("start"), end.alias("end"), ok.alias("ok"), about[1], about[2])
        full = i % PIECE == 0
        pieces = F.when(full, F.concat(acc["pieces"], F.array(acc["out"]))).otherwise(acc["pieces"])
        piece = F.when(full, none).otherwise(acc["out"])
        out = F.when(kept, F.concat(piece, F.array(span).cast(_NO_SPANS))).otherwise(piece)
        return F.struct(end.alias("at"), pieces.alias("pieces"), out.alias("out"), acc["found"].alias("found"), acc["parts"].alias("parts"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_NO_SPANS}>").alias("pieces"), none.alias("out"), found.alias("found"), parts.alias("parts"))
    spans = F.aggregate(F.sequence(F.lit(0), F.size(found) - 1), zero, fold, lambda acc: F.flatten(F.concat(acc["pieces"], F.array(acc["out"]))))
    return F.when(F.size(found) > 0, spans).otherwise(none)


def candidates(docs: DataFrame, keep: str = "doc_id") -> DataFrame:
    """The column `keep` (not text, nor a generator's name) and, in `spans`, every generator's candidates; a digit run inside a secret or phone is also a card candidate."""
    text = F.coalesce("text", F.lit(""))
    cut = {}
    for kind, (pattern, core) in GENERATORS.items():
        has = F.col("text").contains(core) if len(core) == 1 else F.col("text").rlike(core)
        # one column for each, so that both are made once and only where the core is
        cut[kind] = F.when(has, F.struct(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)).alias("found"), F.split("text", pattern, -1).alias("parts")))
    matched = docs.select(keep, text.alias("text")).select(keep, *[c.alias(k) for k, c in cut.items()])
    each = [F.when(F.col(k).isNotNull(), _spans(F.col(f"{k}.found"), F.col(f"{k}.parts"), k)).otherwise(F.array().cast(_NO_SPANS)) for k in GENERATORS]
    return matched.select(keep, F.concat(*each).alias("spans"))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once."""
    return F.get(F.transform(F.array(value), use), 0)


def _before(rows: Column, first: int, step: Callable[[Column, Column], Column]) -> Column:
    """Array of int: what `step` has made of the rows before each one, from `first` on. Gathered in pieces, so that it stays near linear."""
    none = F.array().cast("array<int>")

    def fold(acc: Column, row: Column) -> Column:
        full = F.size(acc["out"]) == PIECE
        out = F.concat(F.when(full, none).otherwise(acc["out"]), F.array(acc["v"]))
        pieces = F.when(full, F.concat(acc["pieces"], F.array(acc["out"]))).otherwise(acc["pieces"])
        return F.struct(step(acc["v"], row).cast("int").alias("v"), pieces.alias("pieces"), out.alias("out"))

    zero = F.struct(F.lit(first).alias("v"), F.array().cast("array<array<int>>").alias("pieces"), none.alias("out"))
    return F.aggregate(rows, zero, fold, lambda acc: F.flatten(F.concat(acc["pieces"], F.array(acc["out"]))))


def _apart(chosen: Column, base: Column) -> Column:
    """The chosen spans that overlap no base span, by start: one sweep over both from the left and one from the right."""
    mark = lambda spans, added: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(added).alias("added"), s["end"].alias("end"), s["kind"].alias("kind")))
    ends = lambda rows: _before(rows, 0, lambda v, s: F.when(s["added"], v).otherwise(F.greatest(v, s["end"])))
    starts = lambda rows: F.reverse(_before(F.reverse(rows), (1 << 31) - 1, lambda v, s: F.when(s["added"], v).otherwise(s["start"])))

    def free(t: Column) -> Column:
        kept = F.filter(t["rows"], lambda s, i: s["added"] & (F.get(t["ends"], i) <= s["start"]) & (F.get(t["starts"], i) >= s["end"]))
        return F.transform(kept, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))

    both = F.sort_array(F.concat(mark(base, False), mark(chosen, True)))
    swept = _let(both, lambda rows: _let(F.struct(rows.alias("rows"), ends(rows).alias("ends"), starts(rows).alias("starts")), free))
    return F.when((F.size(base) > 0) & (F.size(chosen) > 0), swept).otherwise(chosen)


class Tree:
    """Depth two: (feature, cut) at the top and in both halves, four leaves."""

    def __init__(self, top: tuple, halves: tuple, leaves: tuple):
        self.top, self.halves, self.leaves = top, halves, leaves

    def values(self, x: np.ndarray) -> np.ndarray:
        side = lambda node: x[:, node[0]] > node[1]
        (a, b), (c, d) = self.leaves
        return np.where(side(self.top), np.where(side(self.halves[1]), d, c), np.where(side(self.halves[0]), b, a))

    def column(self, features: Column) -> Column:
        over = lambda node: F.get(features, F.lit(int(node[0]))) > F.lit(int(node[1]))
        (a, b), (c, d) = self.leaves
        pick = lambda node, low, high: F.when(over(node), F.lit(float(high))).otherwise(F.lit(float(low)))
        return F.when(over(self.top), pick(self.halves[1], c, d)).otherwise(pick(self.halves[0], a, b))


def _best_cut(x: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple:
    """The (feature, cut) with the largest gain of a Newton step."""
    best, at = -1.0, (0, 1 << 30)
    for j in range(x.shape[1]):
        for cut in np.unique(x[:, j])[:-1].tolist():
            up = x[:, j] > cut
            gain = sum(g[s].sum() ** 2 / (h[s].sum() + 1.0) for s in (up, ~up))
            if gain > best + 1e-12:
                best, at = gain, (j, cut)
    return at


def boost(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> list[Tree]:
    """Newton boosting of the logistic loss on weighted rows."""
    score, trees = np.zeros(len(y)), []
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-score))
        g, h = w * (y - p), w * p * (1 - p)
        top = _best_cut(x, g, h)
        up = x[:, top[0]] > top[1]
        halves, leaves = [], []
        for s in (~up, up):
            node = _best_cut(x[s], g[s], h[s]) if s.any() else (0, 1 << 30)
            high = s & (x[:, node[0]] > node[1])
            halves.append(node)
            leaves.append(tuple(SHRINK * g[t].sum() / (h[t].sum() + 1.0) for t in (s & ~high, high)))
        trees.append(Tree(top, tuple(halves), tuple(leaves)))
        score += trees[-1].values(x)
    return trees


def threshold(score: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
    """The lowest score above which precision, made monotone over scores (isotonic calibration), is MIN_PRECISION."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []  # weight, positives, lowest score
    for i in order:
        if blocks and blocks[-1][2] == score[i]:
            blocks[-1][0] += w[i]
            blocks[-1][1] += w[i] * y[i]
        else:
            blocks.append([w[i], w[i] * y[i], score[i]])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            weight, good, _ = blocks.pop()
            blocks[-1][0] += weight
            blocks[-1][1] += good
    return min((low for weight, good, low in blocks if good >= MIN_PRECISION * weight), default=math.inf)


def fit(docs: DataFrame) -> tuple[list[Tree], float]:
    """Trees and threshold from at most SAMPLE_DOCS documents; half of them, by hash, calibrate (all, if one half has no candidates)."""
    sample = Scratch(docs.sparkSession, "pii").save(hash_sample(docs.select("doc_id", "text"), "doc_id", SAMPLE_DOCS), "sample")
    spans = candidates(sample).select(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)).alias("part"), F.explode("spans").alias("s"))
    rows = spans.groupBy("part", F.col("s.label").alias("label"), F.col("s.features").alias("features")).count().collect()
    if not rows:
        return [], math.inf
    rows.sort(key=lambda r: (r["part"], r["label"], r["features"]))
    x = np.array([r["features"] for r in rows], np.int64)
    part, y, w = (np.array([r[c] for r in rows], np.float64) for c in ("part", "label", "count"))
    train, held = (part == k if (part == k).any() else part >= 0 for k in (0, 1))
    trees = boost(x[train], y[train], w[train])
    score = sum(t.values(x[held]) for t in trees)
    return trees, float(threshold(np.round(score, 9), y[held], w[held]))


def find(docs: DataFrame, model: tuple[list[Tree], float] | None = None, keep: str = "doc_id") -> DataFrame:
    """The column `keep`, base and added: arrays of (kind, start, end), code points, end exclusive, by kind, then start.

    Added spans are the selected candidates that overlap no base span.
    """
    trees, least = fit(docs) if model is None else model
    found = candidates(docs, keep)
    plain = lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))
    base = F.transform(F.filter("spans", lambda s: s["ok"]), plain)
    if not trees or least == math.inf:
        return found.select(keep, base.alias("base"), F.array().cast("array<struct<kind:string,start:int,end:int>>").alias("added"))
    score: Callable[[Column], Column] = lambda s: F.round(sum((t.column(s["features"]) for t in trees[1:]), trees[0].column(s["features"])), 9)
    chosen = F.transform(F.filter("spans", lambda s: ~s["ok"] & s["kind"].isin(*ADDED) & (score(s) >= F.lit(least))), plain)
    free = _apart(F.col("chosen"), F.col("base"))
    of = lambda kind: lambda s: s["kind"] == kind
    ordered = F.concat(*[F.sort_array(F.filter("free", of(kind))) for kind in ADDED])  # of one kind: by start
    return found.withColumns({"base": base, "chosen": chosen}).withColumn("free", free).select(keep, "base", ordered.alias("added"))


#: Code points of a piece of a text, so that a place in a long one is found without reading it from its start.
CHUNK = 4096


def redact(docs: DataFrame, model: tuple[list[Tree], float] | None = None) -> DataFrame:
    """doc_id and text with every selected span replaced by its kind in brackets; null texts stay null. A row for each row, whatever its id.

    Of spans that overlap, the first (the longest, if they start together) is replaced, then what is left of the others; so no letter of a span stays.
    """
    if model is None:
        model = fit(docs)
    own = docs.select(F.struct(F.col("doc_id"), F.col("text")).alias("own"), "text")
    sort = F.sort_array(F.transform(F.concat("base", "added"), lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["end"].alias("end"), s["kind"].alias("kind"))))
    spans = find(own, model, "own").select("own", sort.alias("spans"))
    reach = _before(F.col("spans"), 0, lambda v, s: F.greatest(v, s["end"]))
    text = F.col("own.text")
    chunks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))

    def part(chunks: Column, start: Column, end: Column) -> Column:
        first, last = F.floor(start / CHUNK).cast("int"), F.floor((end - 1) / CHUNK).cast("int")
        whole = F.array_join(F.slice(chunks, first + 1, last - first + 1), "")
        return F.when(end > start, F.substring(whole, start - first * CHUNK + 1, end - start)).otherwise("")

    def done(t: Column) -> Column:
        def replaced(s: Column, i: Column) -> Column:
            at = F.get(t["reach"], i)
            return F.when(s["end"] > at, F.concat(part(t["chunks"], at, s["start"]), F.lit("["), s["kind"], F.lit("]"))).otherwise("")

        last = F.array_max(F.transform(t["spans"], lambda s: s["end"]))
        return F.concat(F.array_join(F.transform(t["spans"], replaced), ""), part(t["chunks"], last, F.length(text)))

    cut = F.struct(F.col("spans").alias("spans"), reach.alias("reach"), chunks.alias("chunks"))
    return spans.select("own.doc_id", F.when(F.size("spans") > 0, _let(cut, done)).otherwise(text).alias("text"))


def report(docs: DataFrame, model: tuple[list[Tree], float] | None = None) -> DataFrame:
    """doc_id, counts of base spans, base_sha256, all spans as kind:start:end, comma-joined, and n_spans, how many these are."""
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    found = find(docs, model)

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, BASE), F.sha2(text(F.col("base")).cast("binary"), 256).alias("base_sha256"), text(F.concat("base", "added")).alias("spans"), F.size(F.concat("base", "added")).cast("long").alias("n_spans"))
