"""Personal data: base patterns, and more spans proposed by wide generators and chosen by boosted trees.

Everything runs as DataFrame expressions. A pattern's matches get offsets by marking them in the text, splitting at
the marks and folding over the parts' lengths; offsets count code points. Patterns never rescan: quantifiers are
possessive and a match starts where its run starts, so long runs take linear time.

*Base* spans are the matches of four patterns that pass their checks. *Candidates* are the matches of the wide
generators, which overlap one another and the base spans: anything around an @ or a written-out "(at)", dotted or coloned
groups, long digit groups with separators, and long tokens of letters and digits (the kind ``secret``, which has no base
pattern). A candidate has format features (digits, separators, groups, brackets, alphabet) and context features (the
characters beside it, a cue word before it).

There are no labels for personal data, so weak ones teach: a candidate is *sure* if it holds a base span or passes a
check of its own kind that base patterns do not make, as a written-out address, eight hexadecimal groups, a valid card
number with unusual separators, a phone number after a cue, a token after ``password=`` or of a known key format. What
a check looks at is no feature of its kind, so the trees learn how such things are written and where they stand. Order
numbers, dates, versions and codes are candidates too, and not sure. Cells of equal features are counted over all
documents with how many are sure; the number of cells is bounded by the features' ranges, so the boosted trees are
fitted to those counts, on the driver. Half of the cells' documents fit the trees and the other half calibrate the
threshold: the lowest score from which on ``PRECISION`` of the candidates would be sure even if one more were not.
The trees are then written as CASE expressions, and find what looks the same without passing a check. A candidate that
touches no base span of its kind is added if it is sure, in tables of any size, or scores above the threshold.

Edge cases: nulls count as empty and have no spans; rows that repeat get equal results; null ids are kept; an empty
table gives no rows; without candidates nothing is added, and with those of one half only, just sure ones are. U+0001 in a text stands for itself (it is swapped for
another control character, which no pattern contains, before marking). Other columns are kept by ``redact`` and
dropped by ``find``.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial, reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
#: With the kind that only the trees find.
ALL_KINDS = (*KINDS, "secret")
MARK, OTHER_MARK = "\x01", "\x02"

#: Each kind's pattern, written so that Java's engine takes linear time.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Wide generators, with the kind that a span of theirs is given.
GENERATORS = {
    "email": r"(?<![^\s@\x01])[^\s@\x01]++@[^\s@\x01]++|(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?+[\[(]at[\])]\x20?+[A-Za-z0-9-]++(?:\x20?+(?:\.|[\[(]dot[\])])\x20?+[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Fa-f.:])[0-9A-Fa-f]++(?:[.:][0-9A-Fa-f]++){3,7}+",
    "card": r"(?<![0-9])[0-9]{4}(?:[\x20._/-]?[0-9]){9,15}(?![0-9])",
    "phone": r"(?<![0-9A-Za-z])[+(]?[0-9](?:[\x20().\-/]{0,2}+[0-9]){6,14}+",
    "secret": r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*+[0-9])(?=[0-9_-]*+[A-Za-z])[A-Za-z0-9_-]{8,}+",
}
OCTET = r"(?:0*+(?:[1-9][0-9]?|1[0-9]{2}|2[0-4][0-9]|25[0-5])|0++)"
SECRET_CUES = r"(?i)(?:pass(?:word|wd|phrase)?|pwd|token|secret|key|credentials?)[\x22'\x20]{0,2}[:=][\x22'\x20]{0,2}$"
PHONE_CUES = r"(?i)(?:tel(?:e?f[oó]no?|ephone)?|phone|call|fax|mobile|handy|m[oó]vil)[^A-Za-z0-9+(]{0,4}$"
CUES = r"(?i)(?:mail|tel|phone|call|fax|card|visa|ip|addr|host|contact|nombre|kontakt)[^A-Za-z0-9]{0,4}$"
#: Least share of base spans among the candidates above the threshold, the boosting rounds and their step.
PRECISION, ROUNDS, STEP = 0.98, 12, 0.5

#: Parts that are folded at a time; even, so that each chunk starts outside a match.
PARTS = 512
_SPANS = "array<struct<start:bigint,end:bigint>>"


def _valid(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        return match.rlike(rf"^{OCTET}\.{OCTET}\.{OCTET}\.{OCTET}$")
    if kind == "card":
        return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _matches(text: Column, pattern: str, keep, value) -> Column:
    """Fold over the parts of the marked text: odd parts are matches. ``keep`` says which count, ``value`` makes of
    (match, start, end) an element. Many parts are folded in chunks, as each append copies what there is."""
    parts = F.split(F.regexp_replace(text, f"({pattern})", f"{MARK}$1{MARK}"), MARK)
    none = F.slice(F.array(value(F.lit(""), F.lit(0).cast("long"), F.lit(0).cast("long"))), 1, 0)

    def step(acc: Column, part: Column) -> Column:
        end = acc["at"] + F.length(part)
        hit = acc["odd"] & keep(part)
        return F.struct(end.alias("at"), (~acc["odd"]).alias("odd"), F.when(hit, F.concat(acc["found"], F.array(value(part, acc["at"], end)))).otherwise(acc["found"]).alias("found"))

    def fold(chunk: Column, start: Column) -> Column:
        return F.aggregate(chunk, F.struct(start.alias("at"), F.lit(False).alias("odd"), none.alias("found")), step)["found"]

    def folded(chunks: Column) -> Column:
        size = lambda chunk: F.aggregate(chunk, F.lit(0).cast("long"), lambda n, part: n + F.length(part))
        before = F.aggregate(chunks, F.array(F.lit(0).cast("long")), lambda acc, chunk: F.concat(acc, F.array(F.element_at(acc, -1) + size(chunk))))
        starts = F.slice(before, 1, F.size(chunks))
        return F.flatten(F.zip_with(chunks, starts, fold))

    def dealt(all_parts: Column) -> Column:
        last = F.floor((F.size(all_parts) - 1) / PARTS).cast("int")
        chunks = F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(all_parts, k * PARTS + 1, F.lit(PARTS)))
        return F.when(F.size(all_parts) <= PARTS, fold(all_parts, F.lit(0).cast("long"))).otherwise(_let(chunks, folded))

    return _let(parts, dealt)


def _let(value: Column, then) -> Column:
    """``then`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _span(_: Column, start: Column, end: Column) -> Column:
    return F.struct(start.alias("start"), end.alias("end"))


def _clean(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), MARK, OTHER_MARK)


def _if_any(kind: str, text: Column, then: Column, otherwise: Column) -> Column:
    """Skip texts that lack the one character which the kind's patterns cannot do without."""
    need = text.contains("@") | text.contains("at)") | text.contains("at]") if kind == "email" else text.rlike("[0-9]")
    return F.when(need, then).otherwise(otherwise)


def base_spans(text: Column) -> dict[str, Column]:
    """For each kind, the spans of the valid matches in a text without marks."""
    none = F.array().cast(_SPANS)
    return {k: _if_any(k, text, _matches(text, BASE[k], partial(_valid, k), _span), none) for k in KINDS}


def _features(text: Column, kind: str, c: Column) -> Column:
    """One number for the format and context of the candidate ``c`` (match, start, end): mixed radix of features."""
    match = c["match"]
    before = F.substr(text, F.greatest(F.lit(1), c["start"] - 23), F.least(c["start"], F.lit(24)))
    after = F.substr(text, c["end"] + 1, F.lit(1))
    digits = F.length(F.regexp_replace(match, "[^0-9]", ""))
    values = _feature_list(kind, match, before, after, digits)
    return reduce(lambda acc, v: acc * v[1] + F.least(F.greatest(v[0].cast("int"), F.lit(0)), F.lit(v[1] - 1)), values, F.lit(0))


def _feature_list(kind: str, match: Column, before: Column, after: Column, digits: Column) -> list[tuple[Column, int]]:
    separators = F.length(F.regexp_replace(match, "[A-Za-z0-9]", ""))
    length = F.length(match)
    cue = F.lit(0) if kind in ("phone", "secret") else before.rlike(CUES)  # their checks look at cues
    return [
        (F.when(digits < 7, 0).when(digits < 9, 1).when(digits < 12, 2).when(digits < 13, 3).when(digits < 16, 4).when(digits == 16, 5).otherwise(6), 7),
        (separators, 5),
        (match.contains("("), 2),
        (match.rlike("[A-Za-z]"), 2),
        (match.rlike(r"\.[A-Za-z]{2,}$"), 2),
        (match.rlike(r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$"), 2),
        (before.rlike(r"[A-Za-z0-9]$"), 2),
        (before.rlike(r"[+]$") | match.startswith("+"), 2),
        (after.rlike("[A-Za-z0-9]"), 2),
        (cue, 2),
        (before.rlike(r"[:=][\x22'\x20]{0,2}$"), 2),
        (before.rlike(r"[\x22'(\[<]$"), 2),
        (match.rlike("^[A-Z0-9]+$"), 2),
        (match.rlike("^[0-9a-f]+$"), 2),
        (F.when(length < 12, 0).when(length < 20, 1).when(length < 32, 2).otherwise(3), 4),
    ]


#: The features' ranges.
RADIX = (7, 5, 2, 2, 2, 2, 2, 2, 2, 2, 2, 2, 2, 2, 4)


def _sure(kind: str, text: Column, c: Column) -> Column:
    """The weak label of a candidate beyond base spans: a check that only what is personal is likely to pass."""
    match = c["match"]
    before = F.substr(text, F.greatest(F.lit(1), c["start"] - 23), F.least(c["start"], F.lit(24)))
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "email":
        return match.rlike(r"[\[(]at[\])]")
    if kind == "ip":
        return match.rlike("^(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}$")
    if kind == "card":
        return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return before.rlike(PHONE_CUES)
    return before.rlike(SECRET_CUES) | match.rlike("^A[KS]IA[A-Z0-9]{16}$")


def _candidates(text: Column, base: dict[str, Column], kind: str) -> Column:
    """Array of (start, end, cell, whether it touches a base span, whether it is sure)."""
    take = lambda m, a, b: F.struct(m.alias("match"), a.alias("start"), b.alias("end"))
    found = _matches(text, GENERATORS[kind], lambda _: F.lit(True), take)
    held = lambda c: F.exists(base[kind], lambda s: (s["start"] < c["end"]) & (c["start"] < s["end"])) if kind in base else F.lit(False)
    made = F.transform(found, lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), _features(text, kind, c).alias("cell"), held(c).alias("base"), _sure(kind, text, c).alias("sure")))
    return _if_any(kind, text, made, F.array().cast("array<struct<start:bigint,end:bigint,cell:int,base:boolean,sure:boolean>>"))


@dataclass(frozen=True)
class Trees:
    """Trees of depth two: (first feature, cut, second feature, cut, four leaf values); score = sum of the leaves."""

    trees: tuple
    start: float
    threshold: float | None


def _prepared(docs: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """``keep``, the text without marks, and the base spans by kind."""
    df = docs.select(*keep, _clean(F.col("text")).alias("_t"))
    return df.withColumns({f"_{k}": v for k, v in base_spans(F.col("_t")).items()})


def fit(docs: DataFrame) -> dict[str, Trees]:
    """Trees for each kind, from the counts of all candidates' cells in all documents."""
    df = _prepared(docs, ()).withColumn("_half", F.pmod(F.xxhash64("_t"), F.lit(2)))
    base = {k: F.col(f"_{k}") for k in KINDS}
    cell_of = lambda i: lambda c: F.struct(F.lit(i).alias("kind"), c["cell"].alias("cell"), (c["base"] | c["sure"]).alias("sure"))
    rows = F.flatten(F.array(*[F.transform(_candidates(F.col("_t"), base, k), cell_of(i)) for i, k in enumerate(ALL_KINDS)]))
    cells = df.select("_half", F.explode(rows).alias("c")).groupBy("c.kind", "c.cell", F.col("_half").alias("half")).agg(F.count("*").alias("n"), F.count_if("c.sure").alias("pos")).toPandas()
    return {k: _boost(cells[cells["kind"] == i]) for i, k in enumerate(ALL_KINDS)}


def _digits_of(cell: np.ndarray) -> np.ndarray:
    out = np.zeros((len(cell), len(RADIX)), np.int64)
    for j in range(len(RADIX) - 1, -1, -1):
        out[:, j], cell = cell % RADIX[j], cell // RADIX[j]
    return out


def _boost(cells) -> Trees:
    """Gradient boosting of depth-2 trees on weighted cells, Newton leaves; threshold from the other half."""
    cells = cells.sort_values(["cell", "half"])
    x, n, pos, half = _digits_of(cells["cell"].to_numpy(np.int64)), cells["n"].to_numpy(float), cells["pos"].to_numpy(float), cells["half"].to_numpy()
    fit_rows = half == 0
    if not len(x) or not n[fit_rows].sum() or not n[~fit_rows].sum():
        return Trees((), 0.0, None)
    rate = (pos[fit_rows].sum() + 0.5) / (n[fit_rows].sum() + 1)
    start = float(np.log(rate / (1 - rate)))
    score = np.full(len(x), start)
    trees = []

    def split(rows: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[int, int]:
        best, at = -1.0, (0, 0)
        for j, radix in enumerate(RADIX):
            for cut in range(radix - 1):
                left = rows & (x[:, j] <= cut)
                right = rows & ~left
                gain = sum(g[r].sum() ** 2 / (h[r].sum() + 1) for r in (left, right))
                if gain > best + 1e-12:
                    best, at = gain, (j, cut)
        return at

    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-score))
        g, h = np.where(fit_rows, pos - n * p, 0.0), np.where(fit_rows, n * p * (1 - p), 0.0)
        j, cut = split(fit_rows, g, h)
        parts, sides = [], []
        for side in (x[:, j] <= cut, x[:, j] > cut):
            k, second = split(fit_rows & side, g, h)
            leaves = []
            for leaf in (side & (x[:, k] <= second), side & (x[:, k] > second)):
                value = float(round(STEP * g[leaf].sum() / (h[leaf].sum() + 1), 6))
                score[leaf] += value
                leaves.append(value)
            parts.append((k, second, *leaves))
            sides.append(side)
        trees.append((j, cut, *parts))
    order = np.argsort(-score[~fit_rows], kind="stable")
    s, c, good = score[~fit_rows][order], np.cumsum(n[~fit_rows][order]), np.cumsum(pos[~fit_rows][order])
    ends = np.append(s[1:] != s[:-1], True)
    fine = ends & (good >= PRECISION * (c + 1))  # with one more that is not sure, so that few candidates prove little
    return Trees(tuple(trees), start, float(s[np.flatnonzero(fine)[-1]]) if fine.any() else None)


def _score(trees: Trees, cell: Column) -> Column:
    scale = np.cumprod((1, *RADIX[:0:-1]))[::-1]
    feature = lambda j: F.floor(cell / int(scale[j])) % RADIX[j]
    leaf = lambda part: F.when(feature(part[0]) <= part[1], F.lit(part[2])).otherwise(F.lit(part[3]))
    return reduce(lambda acc, t: acc + F.when(feature(t[0]) <= t[1], leaf(t[2])).otherwise(leaf(t[3])), trees.trees, F.lit(trees.start))


def find(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), models: dict[str, Trees] | None = None) -> DataFrame:
    """``keep``, and for each kind its base spans (``email``, ...) and all its spans (``email_all``, ...), by start; of
    the kind ``secret`` there are only ``secret_all``."""
    models = models or fit(docs)
    df = _prepared(docs, keep)
    base = {k: F.col(f"_{k}") for k in KINDS}
    above = lambda m, c: F.lit(False) if m.threshold is None else _score(m, c["cell"]) >= m.threshold - 1e-9
    likely = lambda m: lambda c: ~c["base"] & (c["sure"] | above(m, c))
    out = []
    for k in ALL_KINDS:
        every = base.get(k, F.array().cast(_SPANS))
        chosen = F.filter(_candidates(F.col("_t"), base, k), likely(models[k]))
        every = F.array_sort(F.concat(every, F.transform(chosen, lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end")))))
        out += [*([base[k].alias(k)] if k in base else []), every.alias(f"{k}_all")]
    return df.select(*keep, *out)


def joined(spans: dict[str, Column]) -> Column:
    """kind:start:end of all spans, by kind as listed, then start, joined by commas."""
    text = lambda k: lambda x: F.concat(F.lit(f"{k}:"), x["start"].cast("string"), F.lit(":"), x["end"].cast("string"))
    return F.array_join(F.concat(*[F.transform(s, text(k)) for k, s in spans.items()]), ",")


def redact(docs: DataFrame) -> DataFrame:
    """The same columns, with ``[KIND]`` in place of every span in ``text`` and ``n_chars`` counted anew.

    Overlapping spans are replaced together, under the kind of the one that starts first. Texts without spans, nulls
    among them, stay as they are."""
    columns = docs.columns
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row"), F.col("text"))
    found = find(packed, ("_row",), fit(docs))
    text = F.col("_row.text")
    named = lambda k: lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("less"), F.lit(k.upper()).alias("kind"))
    every = F.array_sort(F.concat(*[F.transform(F.col(f"{k}_all"), named(k)) for k in ALL_KINDS]))
    zero = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def step(acc: Column, s: Column) -> Column:
        apart = s["start"] >= acc["at"]
        piece = F.concat(acc["out"], F.substr(text, acc["at"].cast("int") + 1, (s["start"] - acc["at"]).cast("int")), F.lit("["), s["kind"], F.lit("]"))
        return F.struct(F.when(apart, piece).otherwise(acc["out"]).alias("out"), F.greatest(acc["at"], -s["less"]).alias("at"))

    fold = F.aggregate(every, zero, step, lambda acc: F.concat(acc["out"], F.substr(text, acc["at"].cast("int") + 1, F.length(text))))
    new = F.when(F.size(every) > 0, fold).otherwise(text)
    with_text = found.select("_row", new.alias("_new"), (F.size(every) > 0).alias("_hit"))
    picks = {"text": F.col("_new"), "n_chars": F.when(F.col("_hit"), F.length("_new").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("_row.n_chars")) if "n_chars" in columns else None}
    return with_text.select(*[picks[c].alias(c) if picks.get(c) is not None else F.col(f"_row.`{c}`").alias(c) for c in columns])
