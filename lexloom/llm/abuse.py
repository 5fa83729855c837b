"""Abusive, hateful or sexual content: a convolutional classifier on hashed words, trained in numpy."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexloom.functions.text import source_name
from lexloom.session import by_value

#: Labelled rows the classifier is fitted on, at most. All else covers every row.
MAX_LABELS = 20_000
_BINS = 1 << 12
WORDS, FRAMES = 1 << 15, 1 << 11
DIM, FILTERS, WIDTHS = 24, 32, (1, 2, 3, 5)
BATCH, RATE = 128, 4e-3
#: Gradient steps at most, steps between two looks at held-out rows, looks without a gain after which training ends, and what
#: counts as a gain of log-loss.
STEPS, EVERY, PATIENCE, GAIN = 3000, 40, 3, 0.002
#: Words of a piece of a long text.
PIECE = 512
#: A word seen in fewer labelled texts is "some word": names must not become evidence.
LEAST = 3
#: Languages with fewer positive labels share the common threshold.
LEAST_POSITIVE = 40

_SPELLED = re.compile(r"(?<![^\W_])[^\W\d_](?:([.\-_*·])[^\W\d_])(?:\1[^\W\d_])+(?![^\W_])|(?<!\S)[^\W\d_](?: [^\W\d_]){3,}(?!\S)")
_TOKEN = re.compile(r"[@#]\w+|[^\W_](?:[\w*@$!'’​­]*[\w*$])?|[!?]+")
_LEET = str.maketrans("013457@$!", "oieastasi", "'’​­")
_TWICE = re.compile(r"(.)\1+")
_CJK = re.compile(r"[぀-ヿ㐀-鿿฀-๿]")
_HINTS = {
    "de": frozenset("der die das und ist nicht du dein deine bist ein eine mit für von aus den im zu".split()),
    "es": frozenset("el la los las y es no tu eres una un con para de que del por en".split()),
    "fr": frozenset("le la les et est ne pas tu ton es une un avec pour de que du dans des".split()),
    "nl": frozenset("de het een en is niet je bent met voor van uit den dat zijn op".split()),
    "en": frozenset("the and is not you your are a an with for of that in on to my we it i at just rt".split()),
}


def language(text: str) -> str:
    """The language by script and function words; 'en' where nothing tells."""
    for c in text:
        if c > "˿":
            if "Ѐ" <= c <= "ԯ":
                return "ru"
            if "぀" <= c <= "ヿ":
                return "ja"
            if "一" <= c <= "鿿":
                return "zh"
            if "가" <= c <= "힯":
                return "ko"
            if "ऀ" <= c <= "ॿ":
                return "hi"
            if "؀" <= c <= "ۿ":
                return "ar"
            if "฀" <= c <= "๿":
                return "th"
    words = set(text.lower().split())
    return max(("en", "de", "es", "fr", "nl"), key=lambda k: len(words & _HINTS[k]))


def tokens(text: str) -> list[str]:
    """Words under any spelling: letters spelled out are joined, digits and signs for letters undone, drawn-out letters
    shortened; a masked word keeps its frame (w***e)."""
    t = _SPELLED.sub(lambda m: re.sub(r"[.\-_*· ]", "", m.group()), text.lower())
    out = []
    for w in _TOKEN.findall(t):
        c = w[0]
        if c == "@":
            out.append("<user>")
        elif c == "#":
            out.append("<tag>")
        elif c in "!?":
            out.append(c)
        elif "*" in w:
            out.append(f"{c}*{w[-1]}{len(w)}")
        elif w.isdigit():
            out.append("<number>")
        elif _CJK.search(w):
            out.extend(w)
        else:
            if not w.isalpha():
                w = w.translate(_LEET)
            out.append(_TWICE.sub(r"\1", w))
    return out


def _hash(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass"))


def _encode(text: str, memo: dict[str, tuple[int, int]]) -> tuple[list[int], list[int]]:
    words, frames = [], []
    for w in tokens(text):
        got = memo.get(w)
        if got is None:
            frame = w if "*" in w else f"{w[0]}*{w[-1]}{len(w)}"
            got = (2 + _hash(w) % (WORDS - 2), 1 + _hash(frame) % (FRAMES - 1))
            if len(memo) < 100_000:
                memo[w] = got
        words.append(got[0])
        frames.append(got[1])
    return words, frames


def _padded(rows: list[list[int]], least: int) -> np.ndarray:
    out = np.zeros((len(rows), max(least, max(map(len, rows), default=0))), np.int32)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


@dataclass
class Model:
    word: np.ndarray
    frame: np.ndarray
    kernels: list[np.ndarray]
    biases: list[np.ndarray]
    out: np.ndarray
    bias: np.ndarray
    seen: np.ndarray  # buckets of words frequent enough to count
    thresholds: dict[str, float] = field(default_factory=dict)

    def parameters(self) -> list[np.ndarray]:
        return [self.word, self.frame, *self.kernels, *self.biases, self.out, self.bias]

    def pooled(self, w: np.ndarray, f: np.ndarray):
        """(h, x, caches): the maxima of all filters over each text, its embeddings, and where the maxima stand."""
        x = self.word[w] + np.where((f > 0)[..., None], self.frame[f], 0)
        x[w == 0] = 0
        n, length, d = x.shape
        tops, caches = [], []
        for k, b in zip(self.kernels, self.biases, strict=True):
            width = k.shape[0] // d
            win = np.concatenate([x[:, j : length - width + 1 + j] for j in range(width)], axis=2)
            y = (win.reshape(-1, width * d) @ k).reshape(n, -1, k.shape[1])
            at = y.argmax(axis=1)
            top = np.take_along_axis(y, at[:, None], axis=1)[:, 0] + b
            tops.append(np.maximum(top, 0))
            caches.append((at, top > 0))
        return np.concatenate(tops, axis=1), x, caches

    def out_of(self, h: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(h @ self.out + self.bias, -30, 30)))

    def forward(self, w: np.ndarray, f: np.ndarray) -> np.ndarray:
        return self.out_of(self.pooled(w, f)[0])

    def encode(self, texts: list[str], memo: dict) -> list[tuple[list[int], list[int]]]:
        rows = []
        for t in texts:
            w, f = _encode(t, memo)
            rows.append(([x if self.seen[x] else 1 for x in w], f))
        return rows

    def score(self, texts: list[str], memo: dict | None = None) -> np.ndarray:
        """Scores of whole texts; texts are batched by length, the maxima of a very long one are taken piece by piece."""
        memo = {} if memo is None else memo
        rows = self.encode(texts, memo)
        out = np.zeros(len(rows), np.float32)
        short = [i for i, r in enumerate(rows) if 0 < len(r[0]) <= PIECE]  # without words, 0
        for i in (i for i, r in enumerate(rows) if len(r[0]) > PIECE):
            w, f = rows[i]
            step = PIECE - max(WIDTHS) + 1  # every window of words is in some piece
            parts = [(w[s : s + PIECE], f[s : s + PIECE]) for s in range(0, len(w), step)]
            h = np.max([self.pooled(*_batch(parts[s : s + 64]))[0].max(axis=0) for s in range(0, len(parts), 64)], axis=0)
            out[i] = self.out_of(h[None])[0]
        short.sort(key=lambda i: len(rows[i][0]))
        for s in range(0, len(short), 256):
            own = short[s : s + 256]
            out[own] = self.forward(*_batch([rows[i] for i in own]))
        return out


def _batch(rows) -> tuple[np.ndarray, np.ndarray]:
    return _padded([r[0] for r in rows], max(WIDTHS)), _padded([r[1] for r in rows], max(WIDTHS))


def _fresh(rng: np.random.Generator, seen: np.ndarray) -> Model:
    g = lambda *s, scale: (rng.standard_normal(s) * scale).astype(np.float32)
    return Model(g(WORDS, DIM, scale=0.1), g(FRAMES, DIM, scale=0.03), [g(k * DIM, FILTERS, scale=1 / np.sqrt(k * DIM)) for k in WIDTHS], [np.zeros(FILTERS, np.float32) for _ in WIDTHS], g(FILTERS * len(WIDTHS), scale=0.1), np.zeros(1, np.float32), seen)


def train(rows, y: np.ndarray, seen: np.ndarray, seed: int, steps: int = STEPS, held: tuple | None = None):
    """Adam on log-loss, dropout before the output, embeddings updated where they were used.

    Returns the model, the number of steps and the scores of the rows ``held`` out: (rows, labels). With these, training
    ends PATIENCE looks after the last gain, and the scores are those of that look."""
    rng = np.random.default_rng(seed)
    model = _fresh(rng, seen)
    # unknown words alone are no evidence: some texts are blanked and count as harmless
    blank = [([1] * len(rows[i][0]), [0] * len(rows[i][1])) for i in range(0, len(rows), 25)]
    rows = rows + blank
    y = np.concatenate([y, np.zeros(len(blank), np.float32)])
    params = model.parameters()
    m1, m2 = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step, lowest, best, scores = 0, np.inf, 0, None
    while step < steps:
        order = rng.permutation(len(rows))
        # batches of like length, in random order
        chunks = [c for s in range(0, len(order), BATCH * 20) for c in np.array_split(sorted(order[s : s + BATCH * 20], key=lambda i: len(rows[i][0])), max(1, len(order[s : s + BATCH * 20]) // BATCH))]
        rng.shuffle(chunks)
        for chunk in chunks[: steps - step]:
            step += 1
            w, f = _padded([rows[i][0] for i in chunk], max(WIDTHS)), _padded([rows[i][1] for i in chunk], max(WIDTHS))
            w = np.where((w > 1) & (rng.random(w.shape) < 0.08), 1, w)  # any word may be unknown
            h, x, caches = model.pooled(w, f)
            mask = (rng.random(h.shape) < 0.7).astype(np.float32) / 0.7
            p = 1 / (1 + np.exp(-np.clip((h * mask) @ model.out + model.bias, -30, 30)))
            g = ((p - y[chunk]) / len(chunk)).astype(np.float32)
            grads_out, grads_bias = (h * mask).T @ g, np.array([g.sum()], np.float32)
            dh = np.outer(g, model.out) * mask
            dx = np.zeros_like(x)
            gk, gb = [], []
            n = np.arange(len(chunk))[:, None]
            for q, (k, (at, on)) in enumerate(zip(model.kernels, caches, strict=True)):
                d = dh[:, q * FILTERS : (q + 1) * FILTERS] * on
                width = k.shape[0] // DIM
                gb.append(d.sum(axis=0))
                dk = np.empty_like(k)
                for j in range(width):
                    part = x[n, at + j]  # (batch, filter, dim)
                    dk[j * DIM : (j + 1) * DIM] = np.einsum("nfd,nf->df", part, d)
                    np.add.at(dx, (n, at + j), d[:, :, None] * k[j * DIM : (j + 1) * DIM].T[None])
                gk.append(dk)
            dx[w == 0] = 0
            used, back = np.unique(w, return_inverse=True)
            gw = np.zeros((len(used), DIM), np.float32)
            np.add.at(gw, back.ravel(), dx.reshape(-1, DIM))
            fused, fback = np.unique(f, return_inverse=True)
            gf = np.zeros((len(fused), DIM), np.float32)
            np.add.at(gf, fback.ravel(), dx.reshape(-1, DIM))
            gf[fused == 0] = 0
            rate = RATE / (1 + step / 300) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for q, (at, grad) in enumerate([(used, gw), (fused, gf), *((slice(None), k) for k in gk), *((slice(None), b) for b in gb), (slice(None), grads_out), (slice(None), grads_bias)]):
                m1[q][at] = 0.9 * m1[q][at] + 0.1 * grad
                m2[q][at] = 0.999 * m2[q][at] + 0.001 * grad * grad
                params[q][at] -= rate * m1[q][at] / (np.sqrt(m2[q][at]) + 1e-8)
            if held is None or step % EVERY:
                continue
            now = np.concatenate([model.forward(*_batch(held[0][s : s + 256])) for s in range(0, len(held[0]), 256)])
            p = np.clip(now, 1e-6, 1 - 1e-6)
            loss = -float(np.mean(held[1] * np.log(p) + (1 - held[1]) * np.log(1 - p)))
            if loss < lowest - GAIN:
                lowest, best, scores = loss, step, now
            elif step - best >= PATIENCE * EVERY:
                return model, best, scores
    return model, best if held is not None else steps, scores


def _best_threshold(score: np.ndarray, y: np.ndarray) -> float:
    """The threshold of the best F1; the middle of the gap it lies in."""
    order = np.argsort(-score)
    s, hit = score[order], np.cumsum(y[order])
    f1 = 2 * hit / (np.arange(1, len(s) + 1) + y.sum())
    k = int(f1.argmax())
    return float(np.clip((s[k] + (s[k + 1] if k + 1 < len(s) else 0)) / 2, 0.05, 0.95))


def _half(k: int, rows, y: np.ndarray, seen: np.ndarray) -> tuple[int, np.ndarray]:
    """A model of one half of the rows: how many steps served the other half best, and that half's scores."""
    own, other = np.flatnonzero(np.arange(len(rows)) % 2 != k), np.flatnonzero(np.arange(len(rows)) % 2 == k)
    held = [rows[i] for i in other], y[other]
    _, steps, scores = train([rows[i] for i in own], y[own], seen, 7 + k, held=held)
    return steps, scores


def _halves(spark: SparkSession | None, rows, y: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, int]:
    """Each row's score by the model of the half that it is not in, and the steps that serve all rows best. The halves are
    trained in a task each if there is a session."""
    if spark is None:
        got = [(k, *_half(k, rows, y, seen)) for k in (0, 1)]
    else:
        sent = by_value(spark, (rows, y, seen))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for k in b.column(0).to_pylist():
                    steps, scores = _half(k, *sent())
                    yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([steps]), pa.array([scores.astype(np.float32).tobytes()])], names=["k", "steps", "scores"])

        got = [(r.k, r.steps, np.frombuffer(r.scores, np.float32)) for r in spark.range(0, 2, 1, 2).mapInArrow(run, "k bigint, steps bigint, scores binary").collect()]
    out = np.zeros(len(rows), np.float32)
    for k, _, scores in got:
        out[k::2] = scores
    return out, sum(n for _, n, _ in got)  # twice the rows of a half: as many passes


def fit(texts: list[str], labels: np.ndarray, spark: SparkSession | None = None) -> Model:
    """Fit on labelled texts (labels 0 to 1, means of conflicting ones).

    Labels are partly wrong: two models, each trained on one half, score the other half; labels that the scores
    contradict strongly are left out. Two models of the halves of the rest tell how many passes the final fit takes, and
    thresholds are calibrated on their out-of-half scores, by language where there are LEAST_POSITIVE positive labels.
    """
    memo: dict = {}
    encoded = [_encode(t, memo) for t in texts]
    counts = np.zeros(WORDS, np.int64)
    for w, _ in encoded:
        counts[list(set(w))] += 1
    seen = counts >= LEAST
    rows = [([x if seen[x] else 1 for x in w], f) for w, f in encoded]
    y = labels.astype(np.float32)
    if len(rows) < 20 or y.min(initial=1) > 0.5 or y.max(initial=0) < 0.5:
        model = _fresh(np.random.default_rng(7), seen)
        model.out[:] = 0
        model.bias[:] = -5 if not len(y) or y.mean() < 0.5 else 5
        model.thresholds = {"": 0.5}
        return model
    out, _ = _halves(spark, rows, y, seen)
    kept = np.flatnonzero(np.abs(out - y) <= 0.8)
    rows, y = [rows[i] for i in kept], y[kept]
    # on what is left the held-out loss tells how long to train, and the scores where to draw the line
    out, steps = _halves(spark, rows, y, seen)
    model, _, _ = train(rows, y, seen, 9, steps)
    truth = (y >= 0.5).astype(np.float32)
    langs = np.array([language(texts[i]) for i in kept])
    model.thresholds = {"": _best_threshold(out, truth)}
    for lang in np.unique(langs):
        own = langs == lang
        if truth[own].sum() >= LEAST_POSITIVE:
            model.thresholds[str(lang)] = _best_threshold(out[own], truth[own])
    return model


#: Models of this session's samples, by fingerprint; one is some 4 MB.
_FITTED: dict[str, Model] = {}


def fitted(sample: pa.Table, spark: SparkSession) -> Model:
    """The model of a labelled sample, fitted once a session whatever queries ask for it."""
    texts, labels = sample.column("text").to_pylist(), sample.column("label").to_numpy()
    digest = hashlib.sha256("\0".join(texts).encode("utf-8", "surrogatepass") + labels.tobytes()).hexdigest()
    if digest not in _FITTED:
        while len(_FITTED) >= 4:
            _FITTED.pop(next(iter(_FITTED)))
        _FITTED[digest] = fit(texts, labels, spark)
    return _FITTED[digest]


def labelled(cases: DataFrame, labels: DataFrame) -> DataFrame:
    """(case_id, text, label): the mean label of each labelled case with a text, at most MAX_LABELS cases. The cases are those
    of the smallest hashes: a histogram of the hashes gives the limit, so that nothing is sorted or collected to find it."""
    mean = labels.where("case_id is not null and toxic is not null").groupBy("case_id").agg(F.avg(F.col("toxic").cast("double")).alias("label")).withColumn("bin", F.pmod(F.xxhash64("case_id"), F.lit(_BINS)))
    total = F.sum(F.count("*")).over(Window.orderBy("bin"))  # at most _BINS rows
    last = mean.groupBy("bin").agg(total.alias("upto")).where(F.col("upto") <= MAX_LABELS).agg(F.coalesce(F.max("bin"), F.lit(-1))).first()[0]
    chosen = F.broadcast(mean.where(F.col("bin") <= last).drop("bin"))  # at most MAX_LABELS rows
    return cases.where("case_id is not null and prefix is not null").select("case_id", F.col("prefix").alias("text")).join(chosen, "case_id")


def _scored(weights):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, memo = weights(), {}
        for b in batches:
            for s in range(0, b.num_rows, 4096):
                part = b.slice(s, 4096)
                texts = [t or "" for t in part.column(1).to_pylist()]
                p = model.score(texts, memo)
                langs = [language(t) for t in texts]
                limit = np.array([model.thresholds.get(k, model.thresholds[""]) for k in langs], np.float32)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(p.astype(np.float64)), pa.array(langs), pa.array(p >= limit)], names=["case_id", "source", "score", "language", "abusive"])

    return run


def scores(cases: DataFrame, labels: DataFrame) -> DataFrame:
    """(case_id, source, score, language, abusive) of every case; null texts and texts without words score 0.

    The model is fitted once a session on the bounded labelled sample, its halves in a task each, and sent to the executors
    (some 4 MB)."""
    spark = cases.sparkSession
    sample = labelled(cases, labels).toArrow().sort_by([("case_id", "ascending"), ("text", "ascending")])
    weights = by_value(spark, fitted(sample, spark))
    rows = cases.where("case_id is not null").select(F.col("case_id").cast("bigint").alias("case_id"), "prefix", F.coalesce(source_name(F.col("source")), F.lit("")).alias("source"))
    return rows.mapInArrow(_scored(weights), "case_id bigint, source string, score double, language string, abusive boolean")


def abusive(cases: DataFrame, labels: DataFrame) -> DataFrame:
    return scores(cases, labels).where("abusive").select("case_id").distinct()


def rates(cases: DataFrame, labels: DataFrame) -> DataFrame:
    """(source, cases, abusive, rate, mean_score) of each source, spellings folded; null sources are ''."""
    s = scores(cases, labels)
    return s.groupBy("source").agg(F.count("*").alias("cases"), F.count_if("abusive").alias("abusive"), F.round(F.avg(F.col("abusive").cast("double")), 6).alias("rate"), F.round(F.avg("score"), 6).alias("mean_score"))
