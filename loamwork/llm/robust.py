"""Quality rules: robust multivariate outliers by minimum covariance determinant, per language and source.

1. Every whole text gives counts (kept as they are) and a vector of transformed statistics, in whole multiples of
   1/QUANTUM, so that sums are exact and do not depend on how rows are dealt out; narrow rows from here.
2. A (lang, source) group with MIN_GROUP rows or more (five for each statistic) has an estimate of its own. Smaller ones are
   judged by their language's, and by that of all rows where the language has too few; these are made only if needed.
3. The estimate is the mean and covariance of the half of the rows with the smallest determinant. Concentration steps (the
   half nearest under an estimate gives the next) start from medians and quartiles and from STARTS random subsets, on
   about SAMPLE rows of the group chosen by a hash; all starts take two steps, the best go on until their determinant
   stops falling, and the lowest ones win. A group without more rows is done. In others the best CANDIDATES go on over all
   rows: a step is one pass, which sums up moments by distance bin inside each task, so a hot group sends a bounded
   number of rows; the half is cut inside the bin that completes it. Steps end when no determinant falls any more, and
   the lowest determinant is the estimate.
4. Distances are scaled so that their median is the chi-square median, and rows beyond the cutoff are rejected.

Determinants are of the covariance plus FLOOR squared (the statistics' own granularity) on the diagonal, the regularised form
of the estimate, for which steps do not raise the determinant either. In clean groups most rows have no symbol and no
repeat at all, and a covariance of zero would reject the first clean document that has one. For symbols it is one
in 600 characters: more than 7 % of symbols alone are beyond the cutoff, 5 % are not. Floors near the spread of clean rows, with
distances scaled up too, would reject clean rows by the hundred, whose repeats and digits are none or many.

Defined cases: null text has no words and fails the base rules, as does any text under ``least_words`` words; null lang or
source are groups of their own; groups without rows that pass the base rules need no estimate; ties and repeated
rows count each (equal ones of the sample as one with a weight); an empty table stays empty; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamwork.llm.shared import drop_since, lookup, mark, small, small_batches, tidy, written

#: Smallest deviations of the statistics (same order as in ``vector``), and parts of 1 that they are rounded to.
FLOOR, QUANTUM = np.array([0.25, 0.04, 0.2, 0.15, 0.06, 0.1]), 2048
#: Distance bins, least rows of a group, rows that steps start on, random starts, those that go on, estimates
#: taken to all rows, least fall of a log determinant, groups broadcast, and cells of sums that a task holds.
BINS, MIN_GROUP, SAMPLE, STARTS, BEST, CANDIDATES, FALL, BROADCAST_GROUPS, CELLS = 240, 5 * len(FLOOR), 600, 200, 5, 2, 1e-3, 20_000, 100_000
#: Sums of a cell: rows, values, and products of two (each pair once).
UPPER = np.triu_indices(len(FLOOR))
WIDTH = 1 + len(FLOOR) + len(UPPER[0])
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_SYMBOLS = dict.fromkeys(map(ord, "#*$%&|<>"))
_BLANKS = b" \t\n\x0b\x0c\r"


def counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    chars = len(text) - sum(map(data.count, (bytes([b]) for b in _BLANKS)))
    symbols = len(text) - len(text.translate(_SYMBOLS))
    lines = [x for x in data.split(b"\n") if x.strip(_BLANKS)]
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated_words(words)


def repeated_words(words: list[bytes], width: int = 3) -> int:
    """Words in windows of ``width`` words that the text holds twice or more."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    names: dict[bytes, int] = {}
    codes = np.fromiter((names.setdefault(w, len(names)) for w in words), np.int64, len(words))
    windows = codes[:n]
    for k in range(1, width):
        _, windows = np.unique(windows * len(names) + codes[k : n + k], return_inverse=True)
    often = np.bincount(windows)[windows] > 1
    covered = np.zeros(len(words), bool)
    for k in range(width):
        covered[k : n + k] |= often
    return int(covered.sum())


def vector(text: str, c: tuple[int, ...]) -> list[float]:
    """Transformed statistics of a text with words."""
    words, chars, symbols, dup, repeat = c
    upper = sum(map(str.isupper, text)) if not text.isascii() else sum(map(text.count, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    digits = sum(map(text.count, "0123456789"))
    lines = max(1, text.count("\n") + 1)
    return [float(np.log(chars / words)), *(float(np.sqrt(x)) for x in (symbols / chars, dup / lines, repeat / words, upper / chars, digits / chars))]


def chi_square(p: float, df: int) -> float:
    """Quantile, by Wilson and Hilferty's cube."""
    from statistics import NormalDist

    a = 2 / (9 * df)
    return df * (1 - a + NormalDist().inv_cdf(p) * a**0.5) ** 3


def statistics_of(docs: DataFrame, least_words: int, most_repeat: int) -> DataFrame:
    """doc_id, lang, source, the counts, base_failed and v, the vector in parts of QUANTUM (null where the base rules fail)."""
    schema = "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, v array<long>"

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for a in range(0, batch.num_rows, 2000):
                part, found, vectors = batch.slice(a, 2000), [], []
                for text in part.column("text").to_pylist():
                    c = counts(text)
                    failed = c[0] < least_words or 100 * c[4] > most_repeat * c[0]
                    found.append((*c, failed))
                    vectors.append(None if failed or not c[0] else [round(x * QUANTUM) for x in vector(text, c)])
                columns = [pa.array(x, pa.int64()) for x in list(zip(*found))[:5]]
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in ("doc_id", "lang", "source")), *columns, pa.array([f[5] for f in found], pa.bool_()), pa.array(vectors, pa.list_(pa.int64()))], ["doc_id", "lang", "source", *COUNTS, "base_failed", "v"])

    text = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), *(F.col(c).cast("string").alias(c) for c in ("text", "lang", "source")))
    return text.mapInArrow(tidy(run), schema)


def squared_distance(v: np.ndarray, mean: np.ndarray, inverse: np.ndarray) -> np.ndarray:
    """Of each row from the mean, or from its own mean under its own inverse."""
    d = v - mean
    return np.einsum("ij,jk,ik->i" if inverse.ndim == 2 else "ij,ijk,ik->i", d, inverse, d)


def _estimate(weight: float, total: np.ndarray, products: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Mean, inverse and log determinant of the covariance with its floor, from sums over rows."""
    mean = total / weight
    covariance = products / weight - np.outer(mean, mean)
    covariance = (covariance + covariance.T) / 2 + np.diag(FLOOR**2)
    return mean, np.linalg.inv(covariance), float(np.linalg.slogdet(covariance)[1])


def half(n: float, p: int) -> float:
    """Rows that an estimate of n rows is made from."""
    return min(n, (n + p + 1) // 2)


def concentrate(v: np.ndarray, w: np.ndarray, mean: np.ndarray, inverse: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """The estimate from the nearest half of rows v with weights w."""
    order = np.argsort(squared_distance(v, mean, inverse), kind="stable")
    upto = w[order].cumsum()
    part = np.clip(half(w.sum(), v.shape[1]) - (upto - w[order]), 0, w[order])
    x = v[order]
    return _estimate(part.sum(), part @ x, (x * part[:, None]).T @ x)


def weighted_median(d: np.ndarray, w: np.ndarray, share: float = 0.5) -> float:
    order = np.argsort(d, kind="stable")
    return float(d[order][np.searchsorted(w[order].cumsum(), share * w.sum())])


def determinants(v: np.ndarray, w: np.ndarray, candidates: int = CANDIDATES) -> list[tuple[np.ndarray, np.ndarray, float, float]]:
    """(mean, inverse, log determinant, median of the squared distances) with the lowest determinants that steps find, lowest first."""
    order = np.lexsort(v.T)
    v, w = v[order], w[order].astype(float)
    p = v.shape[1]
    quartiles = np.array([[weighted_median(v[:, k], w, q) for k in range(p)] for q in (0.25, 0.5, 0.75)])
    spread = np.maximum((quartiles[2] - quartiles[0]) / 1.349, FLOOR)
    starts = [(quartiles[1], np.diag(spread**-2.0))]
    rng = np.random.default_rng(len(v))
    for _ in range(STARTS):
        x = v[rng.choice(len(v), min(p + 1, len(v)), replace=False)]
        starts.append(_estimate(len(x), x.sum(axis=0), x.T @ x)[:2])
    tried = []
    for mean, inverse in starts:
        mean, inverse, _ = concentrate(v, w, mean, inverse)
        tried.append(concentrate(v, w, mean, inverse))
    best = []
    for found in sorted(tried, key=lambda e: e[2])[:BEST]:
        while (new := concentrate(v, w, *found[:2]))[2] < found[2] - 1e-9:
            found = new
        if all(abs(found[2] - e[2]) > 1e-9 for e in best):
            best.append(found)
    best.sort(key=lambda e: e[2])
    return [(*e, weighted_median(squared_distance(v, *e[:2]), w)) for e in best[:candidates]]


def distance_bin(d: np.ndarray) -> np.ndarray:
    """Bins of equal width in the logarithm, from 0.01 to 10,000 (beyond: the last)."""
    return np.clip(np.floor((np.log10(np.maximum(d, 1e-9)) + 2) * BINS / 6), 0, BINS - 1).astype(np.int64)


def from_bins(bins: np.ndarray, sums: np.ndarray, p: int) -> tuple[np.ndarray, np.ndarray, float, float]:
    """As ``determinants`` gives, from sums of rows, values and products by distance bin; of the bin that completes the half, a part."""
    order = np.argsort(bins)
    bins, sums = bins[order], sums[order]
    upto = sums[:, 0].cumsum()
    part = np.clip((half(upto[-1], p) - (upto - sums[:, 0])) / sums[:, 0], 0, 1) @ sums
    products = np.zeros((p, p))
    products[UPPER] = products.T[UPPER] = part[p + 1 :]
    middle = int(np.searchsorted(upto, upto[-1] / 2))
    inside = (upto[-1] / 2 - (upto[middle] - sums[middle, 0])) / sums[middle, 0]
    return *_estimate(part[0], part[1 : p + 1], products), float(10 ** ((bins[middle] + inside) * 6 / BINS - 2))


def _matrix(column, width: int) -> np.ndarray:
    """A column of lists of one length, without nulls, as rows of an array."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


FOUND = "name string, n long, candidate int, mean array<double>, inverse array<double>, logdet double, median double"


def _first_estimates(levels: DataFrame, fits: DataFrame) -> DataFrame:
    """FOUND and whole (whether all rows took part) of each group, from about SAMPLE of its rows."""

    def run(pdf):
        import pandas as pd

        v, w = np.array(pdf["v"].tolist()) / QUANTUM, pdf["w"].to_numpy()
        name, n = pdf["name"].iloc[0], int(pdf["n"].iloc[0])
        rows = [(name, n, k, mean.tolist(), inverse.ravel().tolist(), logdet, median, bool(w.sum() == n)) for k, (mean, inverse, logdet, median) in enumerate(determinants(v, w))]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in FOUND.split(", ")] + ["whole"])

    chance = (F.col("code").bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))) * F.col("n") < SAMPLE
    sample = _with(levels, fits).where(chance).groupBy("name", "n", "v").agg(F.count(F.lit(1)).alias("w"))  # equal rows are one
    return sample.groupBy("name").applyInPandas(run, FOUND + ", whole boolean")


def _with(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """rows with their group's columns, by name."""
    side = small(groups, BROADCAST_GROUPS)
    return rows.join(side, "name") if side is not groups else lookup(rows, groups, "name", "code", sizes=groups.select("name", F.col("n").alias("_n")).distinct())


def _pass(levels: DataFrame, state: DataFrame) -> DataFrame:
    """FOUND after one concentration step over all rows from each candidate of state."""
    p = len(FLOOR)

    def sums(batches):
        import pyarrow as pa

        known: dict[str, int] = {}
        cells, totals = np.empty(0, np.int64), np.empty((0, WIDTH), np.int64)

        def summed(at, rows):
            order = np.argsort(at, kind="stable")
            first = np.flatnonzero(np.diff(at[order], prepend=-1))
            return at[order][first], np.add.reduceat(rows[order], first)

        def made():
            names = list(known)
            name, rest = np.divmod(cells, CANDIDATES * BINS)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, totals.size + 1, WIDTH), pa.int32()), pa.array(totals.ravel()))
            return pa.RecordBatch.from_arrays([pa.array([names[k] for k in name], pa.string()), pa.array(rest // BINS, pa.int32()), pa.array(rest % BINS), lists], ["name", "candidate", "bin", "sums"])

        for batch in batches:
            if not batch.num_rows:
                continue
            whole = _matrix(batch.column("v"), p).astype(np.int64)
            v = whole / QUANTUM
            names = batch.column("name").dictionary_encode()
            codes = np.array([known.setdefault(n, len(known)) for n in names.dictionary.to_pylist()])[names.indices.to_numpy()]
            means, inverses = _matrix(batch.column("means"), CANDIDATES * p), _matrix(batch.column("inverses"), CANDIDATES * p * p)
            rows = np.concatenate([np.ones((len(v), 1), np.int64), whole, whole[:, UPPER[0]] * whole[:, UPPER[1]]], axis=1)
            fresh = [(cells, totals)]
            for c in range(CANDIDATES):
                d = squared_distance(v, means[:, c * p : (c + 1) * p], inverses[:, c * p * p : (c + 1) * p * p].reshape(-1, p, p))
                fresh.append(summed((codes * CANDIDATES + c) * BINS + distance_bin(d), rows))
            cells, totals = summed(*(np.concatenate(x) for x in zip(*fresh)))
            if len(cells) > CELLS:
                yield made()
                known, cells, totals = {}, cells[:0], totals[:0]
        if len(cells):
            yield made()

    def estimates(batches):
        import pyarrow as pa

        scale = np.concatenate([[1.0], np.full(p, 1 / QUANTUM), np.full(WIDTH - p - 1, 1 / QUANTUM**2)])
        for batch in batches:
            out = []
            for name, candidate, parts in zip(*(batch.column(c).to_pylist() for c in ("name", "candidate", "parts"))):
                bins, total = np.array([x["bin"] for x in parts]), np.array([x["sums"] for x in parts], float)
                mean, inverse, logdet, median = from_bins(bins, total * scale, p)
                out.append((name, int(total[:, 0].sum()), candidate, mean.tolist(), inverse.ravel().tolist(), logdet, median))
            if out:
                kinds = [pa.string(), pa.int64(), pa.int32(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], [c.split()[0] for c in FOUND.split(", ")])

    # a group with fewer candidates has its last one twice
    tried = state.groupBy("name").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("candidate", "mean", "inverse"))).alias("c"))
    each = lambda f: F.flatten(F.array(*(F.coalesce(F.get("c", F.lit(k)), F.get("c", F.lit(0)))[f] for k in range(CANDIDATES))))
    tried = tried.select("name", "n", each("mean").alias("means"), each("inverse").alias("inverses"))
    partial = _with(levels, tried).select("name", "v", "means", "inverses").mapInArrow(tidy(sums), "name string, candidate int, bin long, sums array<long>")
    total = F.array(*(F.sum(F.col("sums")[k]) for k in range(WIDTH)))  # whole numbers, so exact in any order; 10^11 rows fit
    cells = partial.groupBy("name", "candidate", "bin").agg(total.alias("sums"))
    return cells.groupBy("name", "candidate").agg(F.collect_list(F.struct("bin", "sums")).alias("parts")).mapInArrow(tidy(estimates), FOUND)  # BINS parts at most


def estimates(rows: DataFrame, fits: DataFrame) -> DataFrame:
    """name, mean, inverse and median of each group of fits (name, n), from its rows (name, v, code)."""
    best = lambda df: df.groupBy("name").agg(F.min(F.struct("logdet", "candidate", "n", "mean", "inverse", "median")).alias("e"))
    first = written(_first_estimates(rows, fits), "first")
    done = best(first.where("whole")).select("name", "e.mean", "e.inverse", "e.median")
    state = written(first.where("not whole").drop("whole"), "state")
    if not state.limit(1).count():
        return done
    lowest, turn = state, 0
    while True:  # each turn lowers some determinant by FALL at least, and they are bounded from below by the floor
        new = written(_pass(rows, state), "state")
        old = lowest.select("name", "candidate", F.col("logdet").alias("old"))
        # the first determinants are of a sample, so not to be compared with
        judged = written(new.join(old, ["name", "candidate"]).withColumn("fell", (F.col("logdet") < F.col("old") - FALL) | F.lit(turn == 0)), "judged")
        going = judged.where("fell").drop("old", "fell")
        kept = judged.where("not fell").select("name", "candidate")
        lowest = written(going.unionByName(lowest.join(small(kept), ["name", "candidate"], "left_semi")).unionByName(lowest.join(small(new.select("name", "candidate")), ["name", "candidate"], "left_anti")), "lowest")
        turn += 1
        state = going
        if not going.limit(1).count():
            break
    chosen = best(lowest).select("name", "e.n", F.lit(0).alias("candidate"), "e.mean", "e.inverse")
    chosen = written(chosen, "chosen")
    medians = _pass(rows, chosen).where("candidate = 0").select("name", "median")
    return written(done.unionByName(chosen.select("name", "mean", "inverse").join(medians, "name")), "estimates")


def _name(level: int):
    """The key of a row's group at a level: 2 (lang, source), 1 (lang), 0 (all rows)."""
    part = lambda c: F.coalesce(F.concat(F.lit("="), c), F.lit("-"))
    return F.concat_ws("\x01", F.lit(str(level)), *[part(c) for c in ("lang", "source")[:level]])


def groups_of(stats: DataFrame) -> DataFrame:
    """One row for each (lang, source): name (its own), feeds (names of the groups with an estimate that its rows are in), judge (the one that judges them), and these groups' sizes."""
    own = stats.where("v is not null").groupBy(_name(2).alias("name"), _name(1).alias("language")).agg(F.count(F.lit(1)).alias("n"))
    own = written(own, "groups")
    languages = own.groupBy("language").agg(F.sum("n").alias("n1"), F.min("n").alias("least"))
    total = languages.agg(F.sum("n1").alias("n0"), F.max((F.col("least") < MIN_GROUP) & (F.col("n1") < MIN_GROUP)).alias("all_too"))
    every = own.join(languages, "language").crossJoin(F.broadcast(total))  # one row
    alone, spoken = F.col("n") >= MIN_GROUP, F.col("n1") >= MIN_GROUP
    feeds = F.array_compact(F.array(F.when(alone, F.col("name")), F.when((F.col("least") < MIN_GROUP) & spoken, F.col("language")), F.when(F.col("all_too"), _name(0))))
    sizes = F.transform(feeds, lambda f: F.when(f == F.col("name"), F.col("n")).when(f == F.col("language"), F.col("n1")).otherwise(F.col("n0")))
    judge = F.when(alone, F.col("name")).when(spoken, F.col("language")).otherwise(_name(0))
    return written(every.select("name", "n", feeds.alias("feeds"), sizes.alias("sizes"), judge.alias("judge")), "plan")


def verdicts(stats: DataFrame, cutoff: float) -> DataFrame:
    """stats without v, with judge, distance (scaled squared Mahalanobis distance, null where the base rules fail) and kept."""
    p = len(FLOOR)
    first = mark()
    plan = groups_of(stats)
    coded = stats.where("v is not null").select(_name(2).alias("name"), "v", F.xxhash64("doc_id", "v").alias("code"))
    rows = _with(coded, plan.select("name", "n", "feeds")).select(F.explode("feeds").alias("name"), "v", "code")
    fits = plan.select(F.explode(F.arrays_zip("feeds", "sizes")).alias("f")).select(F.col("f.feeds").alias("name"), F.col("f.sizes").alias("n")).distinct()
    found = estimates(rows, written(fits, "fits"))
    known = plan.select("name", "n", "judge").join(found.withColumnRenamed("name", "judge"), "judge")
    known = written(known, "known")
    drop_since(stats.sparkSession, first, stats, known)
    middle = chi_square(0.5, p)

    def judge(batches):
        import pyarrow as pa

        names = ["doc_id", *COUNTS, "base_failed", "judge"]
        for batch in batches:
            there = batch.column("mean").is_valid().to_numpy(zero_copy_only=False)
            some = batch.filter(pa.array(there))
            distance, kept = np.full(batch.num_rows, np.nan), np.zeros(batch.num_rows, bool)
            if some.num_rows:
                d = squared_distance(_matrix(some.column("v"), p) / QUANTUM, _matrix(some.column("mean"), p), _matrix(some.column("inverse"), p * p).reshape(-1, p, p))
                distance[there] = d * middle / np.maximum(some.column("median").to_numpy(), middle)
                kept[there] = distance[there] <= cutoff
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(distance, mask=~there), pa.array(kept)], [*names, "distance", "kept"])

    passed = stats.where("v is not null").withColumn("name", _name(2)).withColumn("code", F.xxhash64("doc_id"))
    nothing = [F.lit(None).cast(t).alias(c) for c, t in (("judge", "string"), ("mean", "array<double>"), ("inverse", "array<double>"), ("median", "double"))]
    columns = ["doc_id", *COUNTS, "base_failed", "v", "judge", "mean", "inverse", "median"]
    judged = _with(passed, known).select(columns).unionByName(stats.where("v is null").select(*columns[:8], *nothing).select(columns))
    schema = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, judge string, distance double, kept boolean"
    return judged.mapInArrow(tidy(judge), schema)


def quality_rules(docs: DataFrame, least_words: int = 50, most_repeat: int = 50, tail: float = 1e-6) -> DataFrame:
    """doc_id, the counts, base_failed, judge (the group whose estimate judged it), distance and kept, for every row of docs."""
    stats = written(statistics_of(docs, least_words, most_repeat), "statistics")
    return verdicts(stats, chi_square(1 - tail, len(FLOOR)))
