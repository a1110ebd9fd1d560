"""Mixing sources to target weights by iterative proportional fitting."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

#: Target of all values of a margin that have none of their own; they share it as they come.
REST = "*"

# Topics by what a text contains, the first that fits.
TOPICS = (
    ("legal", r"(?i)\blicen[cs]e|copyright"),
    ("contact", r"[\w.+-]@[\w-]+\.\w"),
    ("table", r"\w \| \w[^|\n]* \| "),
)
OTHER_TOPIC = "prose"

#: Rounds of the draw's fit at most, and the largest factor of a value that is taken whole.
_ROUNDS, _LARGEST = 3000, 1e12


def topic_of(text: Column) -> Column:
    """The first of TOPICS whose pattern the text contains, else `prose`; null text is prose.

    Patterns are tried only on texts that hold a sign or letters that every match of theirs has.
    """
    lower = F.lower(text)
    may = {
        "legal": lower.contains("licen") | lower.contains("copyright"),
        "contact": text.contains("@"),
        "table": text.contains(" | "),
    }
    found = F.lit(None).cast("string")
    for name, pattern in reversed(TOPICS):
        found = F.when(may[name] & text.rlike(pattern), F.lit(name)).otherwise(found)
    return F.coalesce(found, F.lit(OTHER_TOPIC))


def n_words(text: Column) -> Column:
    """Number of words between white space; null and empty texts have none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\n\r]+")), F.lit(0)).cast("long")


@dataclass
class Mixture:
    """Calibrated weights: a factor for each value of each margin, and the scale of the sample.

    `drawn` has the factors of the draw, with probabilities of one at most. `fraction` is the expected
    share of all tokens, `shares` those of each margin's values in the draw, and `shortfall` what they
    lack of their target shares: more than nothing where a value has too few tokens, less than
    nothing for those that make up for it.
    """

    factors: dict[str, dict[str, float]]
    rounds: int
    gap: float
    drawn: dict[str, dict[str, float]]
    fraction: float
    shares: dict[str, dict[str, float]]
    shortfall: dict[str, dict[str, float]]

    def weight(self, margins: dict[str, Column]) -> Column:
        """Product of a row's factors: its calibrated weight, up to a scale."""
        return _product(self.factors, margins)

    def probability(self, margins: dict[str, Column]) -> Column:
        return F.least(F.lit(1.0), _product(self.drawn, margins))


def _product(factors: dict[str, dict[str, float]], margins: dict[str, Column]) -> Column:
    total = F.lit(1.0)
    for name, column in margins.items():
        total = total * _lookup(factors[name], column)
    return total


def _lookup(values: dict[str, float], key: Column) -> Column:
    """The value of a key in a table of literals, the rest's where there is none."""
    table = F.create_map(*(x for k, v in values.items() if k != REST for x in (F.lit(k), F.lit(float(v))))) if len(values) > 1 else None
    rest = F.lit(float(values.get(REST, 0.0)))
    return rest if table is None else F.coalesce(F.element_at(table, key), rest)


def _goals(wanted: np.ndarray, there: np.ndarray, whole: float) -> np.ndarray:
    """`whole` tokens dealt in the wanted shares; what a value lacks is dealt to the others in theirs."""
    goals = np.zeros(len(wanted))
    short = np.zeros(len(wanted), dtype=bool)
    while True:
        open_ = ~short & (wanted > 0)
        left = whole - there[short].sum()
        goals[short] = there[short]
        if not open_.any():
            return goals
        goals[open_] = left * wanted[open_] / wanted[open_].sum()
        more = open_ & (goals >= there)
        if not more.any():
            return goals
        short |= more


def _fitted(
    tokens: np.ndarray, codes: list[np.ndarray], wanted: list[np.ndarray], rounds: int, tolerance: float
) -> tuple[list[np.ndarray], int, float]:
    """(factors, rounds taken, largest gap of a share): iterative proportional fitting of weights to shares."""
    factors = [np.ones(len(w)) for w in wanted]
    weights, gap, done = tokens.copy(), 0.0, 0
    for done in range(1, rounds + 1):
        last, gap = gap, 0.0
        for code, share, factor in zip(codes, wanted, factors):
            have = np.bincount(code, weights, len(share))
            have = have / have.sum() if have.sum() > 0 else have
            gap = max(gap, np.abs(have - share).max(initial=0.0))
            step = np.divide(share, have, out=np.zeros(len(share)), where=have > 0)
            factor *= step
            weights = weights * step[code]
        if gap <= tolerance or done > 1 and gap > 0.99 * last:
            break
    return factors, done, gap


def _bounded(
    tokens: np.ndarray, weights: np.ndarray, codes: list[np.ndarray], wanted: list[np.ndarray], fraction: float, tolerance: float
) -> tuple[list[np.ndarray], np.ndarray]:
    """(factors, probabilities): `weights` raked again so that probabilities up to one draw `fraction`.

    A value whose tokens don't suffice is taken whole, and its margin's other values make up for it.
    """
    there = [np.bincount(c, tokens * (weights > 0), len(w)) for c, w in zip(codes, wanted)]
    whole = min(fraction * tokens.sum(), there[0].sum())
    goals = [_goals(w, t, whole) for w, t in zip(wanted, there)]
    factors = [np.ones(len(w)) for w in wanted]
    factors[0] *= whole / (tokens * weights).sum()
    raised = weights * factors[0][0]
    for _ in range(_ROUNDS):
        gap = 0.0
        for code, goal, factor in zip(codes, goals, factors):
            have = np.bincount(code, tokens * np.minimum(1.0, raised), len(goal))
            gap = max(gap, np.abs(have - goal).max() / whole)
            step = np.divide(goal, have, out=np.ones(len(goal)), where=have > 0)
            np.minimum(factor * step, _LARGEST, out=factor)
            raised = weights * np.prod([f[c] for f, c in zip(factors, codes)], axis=0)
        if gap <= tolerance:
            break
    return factors, np.minimum(1.0, raised)


def rake(
    docs: DataFrame,
    margins: dict[str, Column],
    tokens: Column,
    targets: dict[str, dict[str, float]],
    fraction: float = 0.5,
    rounds: int = 50,
    tolerance: float = 1e-6,
) -> Mixture:
    """Fit factors so that weighted tokens meet the target shares of every margin.

    `targets` gives for each margin the shares of its values, scaled to a sum of one over those that
    occur; values not named share what `*` has, in proportion to their tokens, or nothing if it is
    not given. One pass sums tokens by the combination of named values; these sums, whose number
    the targets bound, come to the driver and are fitted there. The fit of the weights stops when all
    shares are within `tolerance`, or no longer come nearer, as where targets contradict what there
    is, or after `rounds`.

    The draw is of `fraction` of all tokens, whatever the targets, or of all tokens whose weight is
    not zero if they are fewer. A value that has fewer tokens than its share of the draw is taken
    whole, with a probability of one, and the other values of its margin share what it lacks in
    proportion to their targets; all margins are raked to these goals. So a value held by few
    documents changes the draw by them only.
    """
    named = {m: [v for v in values if v != REST] for m, values in targets.items()}
    held = {m: F.when(c.isin(named[m]), c).otherwise(F.lit(REST)) if named[m] else F.lit(REST) for m, c in margins.items()}
    cells = (
        docs.select(*(c.alias(m) for m, c in held.items()), tokens.alias("tokens"))
        .groupBy(*margins).agg(F.sum("tokens").cast("double").alias("tokens"))
        .where("tokens > 0").collect()
    )
    total = np.array([r["tokens"] for r in cells], dtype=float)
    values = {m: sorted({r[m] for r in cells}) for m in margins}
    codes = [np.array([values[m].index(r[m]) for r in cells], dtype=np.int64) for m in margins]
    wanted = []
    for m in margins:
        share = np.array([float(targets[m].get(v, 0.0)) for v in values[m]])
        wanted.append(share / share.sum() if share.sum() > 0 else share)
    fitted, done, gap = _fitted(total, codes, wanted, rounds, tolerance)
    weights = np.ones(len(total))
    for code, factor in zip(codes, fitted):
        weights = weights * factor[code]
    factors = {m: {**dict.fromkeys((*named[m], REST), 1.0), **dict(zip(values[m], f.tolist()))} for m, f in zip(margins, fitted)}
    if not len(total) or not weights.max() > 0:
        return Mixture(factors, done, gap, {m: dict.fromkeys(f, 0.0) for m, f in factors.items()}, 0.0, {m: {} for m in margins}, {m: {} for m in margins})
    raised, probability = _bounded(total, weights, codes, wanted, fraction, tolerance)
    drawn = {m: {**factors[m], **dict(zip(values[m], (f * r).tolist()))} for m, f, r in zip(margins, fitted, raised)}
    expected = total * probability
    reached = [np.bincount(c, expected, len(w)) / expected.sum() for c, w in zip(codes, wanted)]
    return Mixture(
        factors, done, gap, drawn, float(expected.sum() / total.sum()),
        {m: dict(zip(values[m], r.tolist())) for m, r in zip(margins, reached)},
        {m: dict(zip(values[m], (w - r).tolist())) for m, w, r in zip(margins, wanted, reached)},
    )


def draw(key: Column, seed: int) -> Column:
    """A number in [0, 1) from a key and a seed, the same in every run."""
    digest = F.md5(F.concat_ws(":", F.lit("mixing"), F.lit(str(seed)), F.coalesce(key.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / float(16**12)


def _key(docs: DataFrame) -> Column:
    """What a row is drawn by: its doc_id, or a hash of what is read of it where that is null."""
    read = F.concat_ws(":", F.lit("row"), *(F.xxhash64(docs[c].cast("string")) for c in ("text", "source", "lang")))
    return F.coalesce(docs["doc_id"].cast("string"), read)


def _parts(docs: DataFrame) -> tuple[dict[str, Column], Column]:
    text = docs["text"].cast("string")
    return {"source": docs["source"].cast("string"), "lang": docs["lang"].cast("string"), "topic": topic_of(text)}, n_words(text)


def mixed(docs: DataFrame, targets: dict[str, dict[str, float]], fraction: float = 0.5, seed: int = 42) -> DataFrame:
    """(doc_id, source, lang, topic, n_tokens, weight, probability, kept) of every document.

    Token counts are words of the whole text. `weight` is the calibrated weight of the document's
    source, language and topic, `probability` that of being drawn, with which expected tokens have
    the shares of the weights as far as there are tokens (see `rake`), `kept` the draw, which depends
    on doc_id and seed only, or on text, source, lang and seed where doc_id is null. Null sources and
    languages, and values without a target, are the rest. Null and empty texts have no tokens and
    topic `prose`; they are drawn as others of their kind. Repeated rows are drawn alike. Other
    columns are not read. An empty table gives no rows.

    Texts are read once, for a table of these columns in the shared folder; the rest is made from it.
    """
    margins, tokens = _parts(docs)
    table = Scratch(docs.sparkSession).keep(
        docs.select(
            docs["doc_id"], docs["source"], docs["lang"], margins["topic"].alias("topic"), tokens.alias("n_tokens"),
            draw(_key(docs), seed).alias("drawn"),
        ),
        "mixing",
    )
    margins = {m: F.col(m).cast("string") for m in margins}
    mixture = rake(table, margins, F.col("n_tokens"), targets, fraction)
    probability = mixture.probability(margins)
    return table.select(
        "doc_id", "source", "lang", "topic", "n_tokens", mixture.weight(margins).alias("weight"),
        probability.alias("probability"), (F.col("drawn") < probability).alias("kept"),
    )


def sample_mixture(docs: DataFrame, targets: dict[str, dict[str, float]], fraction: float = 0.5, seed: int = 42) -> DataFrame:
    """The rows of `docs`, with their columns, that `mixed` draws; no shuffle of documents."""
    margins, tokens = _parts(docs)
    mixture = rake(docs, margins, tokens, targets, fraction)
    return docs.where(draw(_key(docs), seed) < mixture.probability(margins))
