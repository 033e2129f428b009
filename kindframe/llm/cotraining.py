"""Quality classifier by co-training of two views.

The content view sees which words and punctuation a text has; the page view sees metadata: language, source, and what a
crawler records of the layout (length, lines, shares of letters, digits and marks), cut into steps. For each of two
questions (good quality? toxic?) both views learn from the labelled rows. Then, over ROUNDS rounds, each view labels the
unlabelled rows that it is sure of for the other view, unless that one is sure of the contrary; a view teaches only if its
cross-fitted opinions of the labelled rows are better than always giving the most common answer, and learns only what
makes its own such opinions no worse. A view is a logistic regression over
features scaled by how unevenly the two labels use them; pseudo-labels count in these scales, and one weight is shared by
all scales, so features that no labelled row has count too. Opinions that are cross-fitted calibrate each view (Platt) and
weigh the calibrated views together. All documents are then scored where they lie.

Fitting reads at most MOST_LABELLED labelled rows, taken by a hash of the id; their feature numbers reach the driver. All
other rows are the unlabelled pool: a round is one pass over all of them, of which sums by feature number come back, at most
2^BITS for a view, label and question.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kindframe.llm.store import dropped, each, slim, stored

MOST_LABELLED, ROUNDS, FOLDS = 6000, 2, 4
#: Rows that must have a feature for it to count.
LEAST = 3
#: Feature numbers of the two views, the least log ratio of a feature's shares that counts, and steps of fitting.
BITS, LEAST_RATIO, STEPS = (18, 12), (0.7, 0.3), (60, 100)
#: A view is sure at this probability; a pseudo-label counts as this part of a label.
SURE, PSEUDO = 0.97, 0.3
WORD, MARKS = re.compile(r"\w+"), re.compile(r"[^\w\s]{1,3}")
#: A view teaches if its errors are less than this part of the most common answer's.
TEACHES = 0.75
HEADS = ("quality", "toxic")
#: Rows scored together.
TOGETHER = 500


class Numbers(dict):
    """Feature name -> number below 2^BITS. Emptied when large, as it only saves time."""

    def __missing__(self, name: str) -> int:
        if len(self) > 120_000:
            self.clear()
        self[name] = v = zlib.crc32(name.encode("utf-8", "surrogatepass")) & ((1 << BITS[0]) - 1)
        return v


def content(text: str, numbers: Numbers) -> np.ndarray:
    """Numbers of the distinct words, of the kinds of punctuation, and of how often words repeat."""
    words = WORD.findall(text.lower())
    once = set(words)
    once.update(MARKS.findall(text))
    once.add(f"\x00{10 * len(once) // (len(words) + 1)}")
    return np.unique(np.fromiter(map(numbers.__getitem__, once), np.int32, len(once)))


def page(text: str, lang: str | None, source: str | None) -> np.ndarray:
    """Numbers of the language, the source, and coarse and fine steps of each layout statistic."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    n = np.bincount(raw, minlength=256)
    size = max(len(raw), 1)
    letters, upper, digits, space = n[97:123].sum() + n[128:].sum(), n[65:91].sum(), n[48:58].sum(), n[9:14].sum() + n[32]
    marks = len(raw) - letters - upper - digits - space
    stats = (
        math.log1p(len(raw)) / 10, math.log1p(n[10]) / 5, math.log1p(size / (n[10] + 1)) / 8, upper / size * 4, digits / size * 4,
        marks / size * 4, space / size * 4, n[124] / size * 20, n[33] / size * 20, (n[35] + n[36] + n[37] + n[38] + n[42]) / size * 10, math.log1p(size / (space + 1)) / 3,
    )
    names = [f"l{lang}", f"s{source}"]
    for k, v in enumerate(stats):
        step = int(min(v, 4) * 24)
        names += [f"{k}:{step}", f"{k}/{step // 3}"]
    return np.unique(np.array([zlib.crc32(x.encode("utf-8", "surrogatepass")) & ((1 << BITS[1]) - 1) for x in names], np.int32))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


class Rows:
    """Rows of distinct feature numbers, end to end."""

    def __init__(self, rows: list[np.ndarray]):
        self.size = np.array([len(r) for r in rows], np.int64)
        self.numbers = np.concatenate(rows) if rows else np.zeros(0, np.int32)
        self.row = np.repeat(np.arange(len(rows)), self.size)

    def __len__(self) -> int:
        return len(self.size)

    def counts(self, weight: np.ndarray, bits: int) -> np.ndarray:
        """How often each feature occurs, rows counting by weight."""
        return np.bincount(self.numbers, np.repeat(weight, self.size), 1 << bits)

    def of(self, scale: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row and number of the features that count, those whose scale is not 0."""
        some = scale[self.numbers] != 0
        return self.row[some], self.numbers[some]


@dataclass
class View:
    """A fitted view: what each feature adds, its scale, the weight of the mean scale, and the start."""

    weight: np.ndarray
    scale: np.ndarray
    shared: float
    start: float

    def margins(self, rows: Rows) -> np.ndarray:
        at, numbers = rows.of(self.scale)
        n = len(rows)
        k = np.sqrt(np.bincount(at, minlength=n) + 1)
        return np.bincount(at, self.weight[numbers], n) + self.shared * np.bincount(at, self.scale[numbers], n) / k + self.start


@dataclass
class Pseudo:
    """Sums of pseudo-labels: rows with each feature and rows in all, for the answers yes and no."""

    features: tuple[np.ndarray, np.ndarray]
    rows: tuple[float, float]


def no_pseudo(view: int) -> Pseudo:
    return Pseudo((np.zeros(1 << BITS[view]), np.zeros(1 << BITS[view])), (0.0, 0.0))


def fitted(rows: Rows, y: np.ndarray, weight: np.ndarray, view: int, more: Pseudo) -> View:
    """Logistic regression by Adam over all rows that have a weight."""
    up, down = rows.counts(weight * y, BITS[view]) + PSEUDO * more.features[0], rows.counts(weight * (1 - y), BITS[view]) + PSEUDO * more.features[1]
    r = np.log((up + 0.5) / (weight @ y + PSEUDO * more.rows[0] + 1)) - np.log((down + 0.5) / (weight @ (1 - y) + PSEUDO * more.rows[1] + 1))
    r[(up + down < LEAST) | (np.abs(r) < LEAST_RATIO[view])] = 0
    at, numbers = rows.of(r)
    n, scale = len(rows), r[numbers]
    mean = np.bincount(at, scale, n) / np.sqrt(np.bincount(at, minlength=n) + 1)
    # Features that no row here has keep a weight of 0, so only the others are looked at.
    known, place = np.unique(numbers, return_inverse=True)
    w = np.zeros(len(known) + 2)
    m, v, total = np.zeros_like(w), np.zeros_like(w), max(weight.sum(), 1e-9)
    for t in range(1, STEPS[view] + 1):
        e = (sigmoid(np.bincount(at, w[:-2][place] * scale, n) + w[-2] * mean + w[-1]) - y) * weight
        g = np.append(np.bincount(place, e[at] * scale, len(known)), (e @ mean, e.sum())) / total + w / total
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w - 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    out = np.zeros(1 << BITS[view], np.float32)
    out[known] = w[:-2] * r[known]
    return View(out, r.astype(np.float32), float(w[-2]), float(w[-1]))


def logistic(x: np.ndarray, t: np.ndarray, start: np.ndarray, ridge: float) -> np.ndarray:
    """Weights of a small logistic regression with targets t, near start, by Newton's method with steps that never make it worse."""

    def cost(w: np.ndarray) -> float:
        z = x @ w
        return float((np.logaddexp(0, z) - t * z).sum() + ridge / 2 * ((w - start) ** 2).sum())

    w = np.array(start)
    for _ in range(50):
        p = sigmoid(x @ w)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (p - t) + ridge * (w - start))
        part = 1.0
        while part > 1e-6 and cost(w - part * step) > cost(w):
            part /= 2
        w = w - part * step
        if np.abs(part * step).max() < 1e-9:
            break
    return w


def platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(a, b) of sigmoid(a z + b), with targets a little off 0 and 1."""
    up, down = y.sum(), len(y) - y.sum()
    a, b = logistic(np.stack([z, np.ones(len(z))], 1), np.where(y > 0.5, (up + 1) / (up + 2), 1 / (down + 2)), np.array([1.0, 0.0]), 1e-3)
    return max(float(a), 1e-3), float(b)


@dataclass
class Head:
    """A question's two views, their calibration, and the weights of both and of the start in its answer."""

    views: list[View]
    calibration: tuple[tuple[float, float], tuple[float, float]] = ((1.0, 0.0), (1.0, 0.0))
    mix: tuple[float, float, float] = (0.5, 0.5, 0.0)

    def logits(self, rows: tuple[Rows, Rows]) -> np.ndarray:
        calibrated = [a * v.margins(x) + b for v, x, (a, b) in zip(self.views, rows, self.calibration, strict=True)]
        return self.mix[0] * calibrated[0] + self.mix[1] * calibrated[1] + self.mix[2]


@dataclass
class Model:
    heads: dict[str, Head] = field(default_factory=dict)


@dataclass
class Asked:
    """A question's labelled rows and what unlabelled ones have added."""

    rows: tuple[Rows, Rows]
    y: np.ndarray
    more: list[Pseudo] = field(default_factory=lambda: [no_pseudo(0), no_pseudo(1)])

    def views(self) -> list[View]:
        return [fitted(x, self.y, np.ones(len(self.y)), k, self.more[k]) for k, x in enumerate(self.rows)]

    def opinions(self) -> list[np.ndarray]:
        """Each view's margins of the labelled rows, each fold's by a view that has not seen its labels."""
        z, fold = [np.zeros(len(self.y)), np.zeros(len(self.y))], np.arange(len(self.y)) % FOLDS
        for f in range(FOLDS):
            for k, x in enumerate(self.rows):
                z[k][fold == f] = fitted(x, self.y, (fold != f).astype(float), k, self.more[k]).margins(x)[fold == f]
        return z

    def finished(self) -> Head:
        z = self.opinions()
        cal = tuple(platt(v, self.y) for v in z)
        x = np.stack([*(a * v + b for v, (a, b) in zip(z, cal, strict=True)), np.ones(len(self.y))], 1)
        used = np.array([True, True, True])
        mix = mixed(x, self.y, used)
        if (mix[:2] < 0).any():  # a view that would speak against itself stays out
            used = np.append(mix[:2] >= 0, True)
            mix = mixed(x, self.y, used)
        return Head(self.views(), cal, tuple(float(m) for m in mix))


def mixed(x: np.ndarray, y: np.ndarray, used: np.ndarray) -> np.ndarray:
    """Weights of the calibrated views and of 1, near even weights."""
    mix = np.zeros(3)
    mix[used] = logistic(x[:, used], y, np.array([0.5, 0.5, 0.0])[used], 0.1)
    return mix


def loss(z: np.ndarray, y: np.ndarray) -> float:
    """The mean log loss of calibrated margins."""
    a, b = platt(z, y)
    return float(np.logaddexp(0, np.where(y > 0.5, -1, 1) * (a * z + b)).mean())


def sure_of(own: np.ndarray, teacher: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows that the teacher's margins are sure are a yes, and a no, and the own view's are not sure of the contrary."""
    edge = math.log(SURE / (1 - SURE))
    return (teacher > edge) & (own > -edge), (teacher < -edge) & (own < edge)


@slim
def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """_text, _lang, _source and whatever else become _c, _p and that."""
    numbers = Numbers()
    for b in batches:
        c, p = [], []
        for text, lang, source in zip(*(each(b.column(i)) for i in range(3)), strict=True):
            c.append(content(text or "", numbers).tobytes())
            p.append(page(text or "", lang, source).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()), pa.array(p, pa.binary()), *b.columns[3:]], ["_c", "_p", *b.schema.names[3:]])


def _rows_of(columns: list[pa.Array]) -> tuple[Rows, Rows]:
    return tuple(Rows([np.frombuffer(x.as_buffer(), np.int32) for x in c]) for c in columns)


def _told(pool: DataFrame, now: dict[str, list[View]], teaches: dict[str, list[bool]]) -> dict[tuple, list[Pseudo]]:
    """A round: what each view of each question learns from the other's labels of all unlabelled rows."""
    heads = list(now)

    @slim
    def taught(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {(h, k, a): [np.zeros(1 << BITS[k]), 0] for h in range(len(heads)) for k in (0, 1) for a in (0, 1)}
        for b in batches:
            for at in range(0, b.num_rows, TOGETHER):
                rows = _rows_of(b.slice(at, TOGETHER).columns[:2])
                for h, head in enumerate(heads):
                    z = [v.margins(x) for v, x in zip(now[head], rows, strict=True)]
                    for k in (0, 1):
                        if teaches[head][1 - k]:
                            for answer, some in enumerate(sure_of(z[k], z[1 - k])):
                                one = sums[h, k, answer]
                                one[0] += rows[k].counts(some.astype(float), BITS[k])
                                one[1] += int(some.sum())
        for (h, k, a), (found, n) in sums.items():
            if n:
                number = np.flatnonzero(found)
                key = np.append(number + 1, 0) | ((h * 2 + k) * 2 + a) << 20
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.append(found[number], n).astype(np.int64))], ["_key", "_n"])

    # At most 2^BITS rows of two numbers for each question, view and answer: 17 MB in all.
    got = pool.select("_c", "_p").mapInArrow(taught, "_key long, _n long").groupBy("_key").agg(F.sum("_n").alias("_n")).toArrow()
    key, n = (c.to_numpy() for c in got.columns)
    number, a, k, h = (key & ((1 << 20) - 1)) - 1, key >> 20 & 1, key >> 21 & 1, key >> 22
    out = {}
    for i, head in enumerate(heads):
        out[head] = [no_pseudo(0), no_pseudo(1)]
        for view in (0, 1):
            rows = [0.0, 0.0]
            for answer in (0, 1):
                mine = (h == i) & (k == view) & (a == answer)
                some = mine & (number >= 0)
                out[head][view].features[answer][number[some]] = n[some]
                rows[answer] = float(n[mine & (number < 0)].sum())
            out[head][view].rows = tuple(rows)
    return out


def _optional(docs: DataFrame, name: str) -> Column:
    """A column, or a field of one, as text; null where docs has none."""
    outer, _, inner = name.partition(".")
    if name in docs.columns:
        return F.col(f"`{name}`").cast("string")
    there = outer in docs.columns and isinstance(docs.schema[outer].dataType, T.StructType) and inner in docs.schema[outer].dataType.names
    return (F.col(outer).getField(inner) if there else F.lit(None)).cast("string")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", most_labelled: int = MOST_LABELLED, rounds: int = ROUNDS) -> Model:
    """A model from labels (id_col, quality, toxic: 0, 1 or null). Without labels of both kinds a question is not asked.

    An id that is labelled twice counts by its larger labels; labels of unknown ids and null ids are left out. Rows
    without a label of a question, and those beyond most_labelled, are unlabelled; repeated rows count as often as they are.
    """
    told = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_l")).agg(F.max("quality").cast("int").alias("_quality"), F.max("toxic").cast("int").alias("_toxic"))
    order = lambda c: F.xxhash64(F.lit("fit"), F.col(c))
    known = docs.select(F.col(id_col).alias("_id")).where("_id IS NOT NULL")
    some = told.where("_quality IS NOT NULL OR _toxic IS NOT NULL").join(known, F.col("_l") == F.col("_id"), "left_semi").orderBy(order("_l"), "_l").limit(most_labelled)
    # Bounded by its limit, so it may be broadcast.
    met = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), _optional(docs, lang_col).alias("_lang"), _optional(docs, source_col).alias("_source")).join(F.broadcast(some), F.col("_id") == F.col("_l"), "left")
    made = met.select("_text", "_lang", "_source", "_quality", "_toxic", order("_id").alias("_o")).mapInArrow(_features, "_c binary, _p binary, _quality int, _toxic int, _o long")
    features = stored(made, "features")
    labelled = F.col("_quality").isNotNull() | F.col("_toxic").isNotNull()
    rows = features.where(labelled).collect()
    rows.sort(key=lambda r: (r["_o"], bytes(r["_c"])))
    asked: dict[str, Asked] = {}
    for head in HEADS:
        mine = [r for r in rows if r[f"_{head}"] is not None]
        y = np.array([float(r[f"_{head}"] > 0) for r in mine])
        if len(y) >= 2 * FOLDS and 0 < y.sum() < len(y):
            asked[head] = Asked(tuple(Rows([np.frombuffer(r[c], np.int32) for r in mine]) for c in ("_c", "_p")), y)
    pool = features.where(~labelled)
    opinions = {h: q.opinions() for h, q in asked.items()}
    for _ in range(rounds if asked else 0):
        # A view with hardly fewer errors than the most common answer has has nothing to teach.
        teaches = {h: [float(((z > 0) != (q.y > 0.5)).mean()) < TEACHES * min(q.y.mean(), 1 - q.y.mean()) for z in opinions[h]] for h, q in asked.items()}
        for h, more in _told(pool, {h: q.views() for h, q in asked.items()}, teaches).items():
            q = asked[h]
            after = Asked(q.rows, q.y, more).opinions()
            # What a view learned stays if its opinions of the labelled rows are no worse for it.
            for k in (0, 1):
                if loss(after[k], q.y) <= loss(opinions[h][k], q.y):
                    q.more[k], opinions[h][k] = more[k], after[k]
    model = Model({h: q.finished() for h, q in asked.items()})
    dropped(features)
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """docs plus p_quality, p_toxic and keep (good and not toxic, each at probability 1/2).

    A null text is empty. A question that the model does not ask has the answer that keeps. Input columns of the added
    names are replaced; others pass through; repeated rows stay; an empty table gives an empty table.
    """
    added = ("p_quality", "p_toxic", "keep")
    keep = [c for c in docs.columns if c not in added]
    rows = docs.select(*[F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(keep)], F.coalesce(F.col(text_col), F.lit("")).alias("_text"), _optional(docs, lang_col).alias("_lang"), _optional(docs, source_col).alias("_source"))
    schema = T.StructType([*[f for f in rows.schema if f.name.startswith("_k")], T.StructField("_q", T.DoubleType()), T.StructField("_t", T.DoubleType())])
    heads = [model.heads.get(h) for h in HEADS]

    @slim
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = Numbers()
        for b in batches:
            p: list[list[np.ndarray]] = [[] for _ in heads]
            for at in range(0, b.num_rows, TOGETHER):
                part = list(zip(*(each(c.slice(at, TOGETHER)) for c in b.columns[-3:]), strict=True))
                seen = Rows([content(t, numbers) for t, _, _ in part]), Rows([page(*x) for x in part])
                for k, h in enumerate(heads):
                    p[k].append(sigmoid(h.logits(seen)) if h else np.full(len(part), 1.0 - k))
            yield pa.RecordBatch.from_arrays([*b.columns[:-3], *[pa.array(np.concatenate([np.zeros(0), *x])) for x in p]], schema.names)

    done = rows.mapInArrow(run, schema)
    return done.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)], F.col("_q").alias("p_quality"), F.col("_t").alias("p_toxic"), ((F.col("_q") >= 0.5) & (F.col("_t") < 0.5)).alias("keep"))


def op9_cotraining(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    return score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))).drop("text")
