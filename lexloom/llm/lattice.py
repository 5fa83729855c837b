"""Lattices for sentence boundaries: words of spaceless scripts, and the two readings of every possible end.

The dictionary of spaceless scripts is counted over all documents: substrings whose neighbours vary on both sides, how
often they open or close a line, and how often they stand behind or before a blank inside one.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.session import cut

#: Longest word of the dictionary in code points.
LONGEST = 14
#: A word occurs at least once in 1 / SHARE characters of its script, so that the dictionary has a bounded size at every size
#: of the corpus: 1 / SHARE substrings of each length and script at most. It occurs LEAST times at least.
SHARE, LEAST = 5e-5, 3
#: A substring is a word if no single neighbour takes more than this share of its occurrences.
FIXED = 0.7
#: Buckets of the first count in each script, which only tells what may be frequent; one bit each is broadcast.
BUCKETS = 1 << 20
#: Buckets whose counts travel in one row.
BLOCK = 256
#: Earlier ends that are weighed as the start of a sentence one by one.
BACK = 6

SCRIPTS = {"thai": "฀-๿", "lao": "຀-໿", "burmese": "က-႟", "khmer": "ក-៿", "cjk": "々぀-ヿ㐀-䶿一-鿿豈-﫿"}
SPACELESS = "".join(SCRIPTS.values())
_RUN = re.compile(rf"[{SPACELESS}]+(?:\.[{SPACELESS}]*)*")
_CJK = re.compile(f"[{SCRIPTS['cjk']}]")
_LINE = re.compile(r"[^\n\r\x85  \x0b\x0c]+")
_STOPS = frozenset("。！？｡．!?។៕။๚๛…")
_SCRIPT = [(k, re.compile(f"[{v}]")) for k, v in SCRIPTS.items()]

#: General words of each script, used where the documents tell nothing: words that open sentences, words that continue one
#: behind a blank, final particles, and words that a name follows.
OPENING = frozenset(
    "แต่ เพราะ ถ้า เมื่อ วันนี้ เมื่อวาน พรุ่งนี้ ตอน ผม ฉัน ดิฉัน เขา เธอ เรา มัน พวกเขา จากนั้น ต่อมา แล้ว ดังนั้น อย่างไรก็ตาม ทำไม ใคร "
    "ແຕ່ ເພາະ ຖ້າ ມື້ນີ້ ມື້ວານ ຂ້ອຍ ເຂົາ ລາວ ພວກເຮົາ ຕອນ ຈາກນັ້ນ ដូច្នេះ ប៉ុន្តែ ព្រោះ ប្រសិនបើ ថ្ងៃនេះ ម្សិលមិញ ខ្ញុំ គាត់ នាង យើង ពួកគេ "
    "ဒါပေမဲ့ သို့သော် ဒါကြောင့် ယနေ့ မနေ့က ကျွန်တော် ကျွန်မ သူ သူမ ကျွန်ုပ် 但是 因为 如果 今天 昨天 明天 我 你 他 她 它 我们 他们 所以 然后 しかし だから もし 今日 昨日 明日 私 彼 彼女 そして でも".split()
)
GOING_ON = frozenset("และ หรือ กับ ที่ ซึ่ง ว่า ของ โดย ใน ให้ ๆ ฯ ฯลฯ คือ ແລະ ຫຼື ກັບ ທີ່ ວ່າ ຂອງ ໂດຍ និង ឬ ជាមួយ ដែល ថា របស់ နှင့် သို့မဟုတ် ၏ 和 或 与 的 と や の は が を に".split())
FINAL = frozenset("ครับ ค่ะ คะ นะ แล้ว ไหม มั้ย จ้ะ จ้า เลย ด้วย สิ ล่ะ ແດ່ ເດີ ບໍ ແລ້ວ ຈ້າ ទេ ហើយ ណា တယ် သည် မယ် ပါ လား 了 吗 呢 吧 啊 です ます でした ました ません だ よ ね か た".split())
BEFORE = frozenset("ดร. นาย นาง นางสาว คุณ ศ. รศ. ผศ. พล.อ. เช่น คือ ว่า และ หรือ ที่ ของ ກັບ ທ່ານ ດຣ. លោក លោកស្រី វេជ្ជបណ្ឌិត ဦး ဒေါ် ဒေါက်တာ".split())


def script(c: str) -> str | None:
    for name, pattern in _SCRIPT:
        if pattern.match(c):
            return name
    return None


def _owners() -> np.ndarray:
    """The number of the script of each code point; what has none is never a substring's start but for the full stop."""
    out = np.zeros(0xFB00, np.int64)
    for k, (_, pattern) in enumerate(_SCRIPT):
        out[[c for c in range(0x0E00, len(out)) if not 0xD800 <= c < 0xE000 and pattern.match(chr(c))]] = k
    return out


_OWN = _owners()


@dataclass
class Lexicon:
    """``words``: the cost of each word; ``opens`` and ``closes``: how much more often a word opens (closes) lines than it
    follows (precedes) a blank inside one, as log-odds; ``carries``: the same of closing for what follows a short chunk, such
    as a title; ``lengths``: mean and deviation of the logarithm of whole sentences'
    lengths in each script."""

    words: dict[str, float] = field(default_factory=dict)
    opens: dict[str, float] = field(default_factory=dict)
    closes: dict[str, float] = field(default_factory=dict)
    carries: dict[str, float] = field(default_factory=dict)
    lengths: dict[str, tuple[float, float]] = field(default_factory=dict)
    unknown: float = 12.0

    def cost(self, word: str) -> float | None:
        got = self.words.get(word)
        return 8.0 if got is None and (word in OPENING or word in GOING_ON or word in FINAL) else got

    def path(self, piece: str) -> list[str]:
        """The cheapest path through the word lattice of ``piece``."""
        n = len(piece)
        best, back = [0.0] + [math.inf] * n, [0] * (n + 1)
        for i in range(n):
            here = best[i]
            if here + self.unknown < best[i + 1]:
                best[i + 1], back[i + 1] = here + self.unknown, i
            for j in range(i + 1, min(n, i + LONGEST) + 1):
                c = self.cost(piece[i:j])
                if c is not None and here + c < best[j]:
                    best[j], back[j] = here + c, i
        words, j = [], n
        while j:
            words.append(piece[back[j] : j])
            j = back[j]
        words.reverse()
        return words

    def first(self, piece: str) -> str:
        return self.path(piece[: 3 * LONGEST])[0]

    def last(self, piece: str) -> str:
        return self.path(piece[-3 * LONGEST :])[-1]

    def opening(self, piece: str) -> float:
        """How much the start of ``piece`` speaks for a new sentence."""
        word = self.first(piece)
        known = self.opens.get(word, None if word in OPENING or word in GOING_ON else self.opens.get(f"\0{script(word[0])}"))
        return known if known is not None else 1.5 * (word in OPENING) - 3.0 * (word in GOING_ON)

    def closing(self, piece: str) -> float:
        """How much the end of ``piece`` speaks for the end of a sentence."""
        word = self.last(piece)
        if piece in BEFORE and piece not in self.closes:
            return -4.0
        known = self.closes.get(word, None if word in FINAL or word in BEFORE else self.closes.get(f"\0{script(word[0])}"))
        return known if known is not None else 1.5 * (word in FINAL) - 4.0 * (word in BEFORE)

    def length(self, name: str, n: int) -> float:
        """What is far shorter than whole sentences of the script is none."""
        mean, deviation = self.lengths.get(name, (math.log(22), 0.75))
        z = (math.log(max(n, 1)) - mean) / deviation
        return min(0.0, 1.5 * (z + 2))


def _marked(texts: list[str]):
    """Code points of all spaceless runs with a 0 behind each, and at each of them: 1 where a line opens, 2 behind a blank
    inside one; the same for closing. Also the lengths of lines without a blank, and the numbers of those places, by script."""
    pieces, opens, closes, lengths, places = [], [], [], [], {}
    for t in texts:
        for m in _LINE.finditer(t):
            line, behind = m.group().strip(), None
            for r in _RUN.finditer(line):
                a, b = r.span()
                run = r.group()
                before, after = line[a - 1] if a else "", line[b] if b < len(line) else ""
                pieces.append(run)
                opens.append(1 if not before or before in _STOPS else 2 if before.isspace() else 0)
                closes.append(1 if not after or after in _STOPS else 2 if after.isspace() else 0)
                own = script(run[0])
                place = places.setdefault("\0\0" + own, np.zeros(5))
                place[opens[-1]] += opens[-1] > 0
                place[2 + closes[-1]] += closes[-1] > 0
                # what follows a short chunk, such as a title, may never close a line
                if behind is not None and a == behind[1] + 1 and line[behind[1]].isspace() and behind[1] - behind[0] <= LONGEST:
                    place = places.setdefault("\0\0\0" + line[behind[0] : behind[1]], np.zeros(5))
                    place[0] += 1
                    place[2 + closes[-1]] += closes[-1] > 0
                behind = (a, b) if opens[-1] else None
                if b - a == len(line):
                    lengths.append((own, math.log(b - a)))
    text = "\0".join(pieces) + "\0"
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    at = np.flatnonzero(codes == 0)
    opening, closing = np.zeros(len(codes), np.int8), np.zeros(len(codes), np.int8)
    if pieces:
        opening[np.concatenate([[0], at[:-1] + 1])] = opens
        closing[at - 1] = closes
    return text, codes, opening, closing, lengths, list(places.items())


def _grams(codes: np.ndarray):
    """(n, start, hash) of all substrings of up to LONGEST code points within runs."""
    h = np.zeros(len(codes), np.uint64)
    ok = np.ones(len(codes), bool)
    for n in range(1, LONGEST + 1):
        if n > len(codes):
            return
        c = codes[n - 1 :].astype(np.uint64)
        h, ok = h[: len(c)], ok[: len(c)] & (c != 0)
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + c
        start = np.flatnonzero(ok)
        yield n, start, h[start] * np.uint64(0xBF58476D1CE4E5B9)


def _bucket(codes: np.ndarray, start: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A bucket of the script that the substring starts in."""
    return _OWN[np.minimum(codes[start], len(_OWN) - 1)] * BUCKETS + ((h >> np.uint64(44)).astype(np.int64) & (BUCKETS - 1))


def _texts(batches: Iterator[pa.RecordBatch]):
    for b in batches:
        for s in range(0, b.num_rows, 2048):
            yield [t for t in b.column(0).slice(s, 2048).to_pylist() if t]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, counts, total): the numbers of substrings in BLOCK buckets each; the block -1 - k has the characters of script k."""
    totals, counts = np.zeros(len(SCRIPTS), np.int64), np.zeros(len(SCRIPTS) * BUCKETS, np.int32)
    for texts in _texts(batches):
        _, codes, *_ = _marked(texts)
        totals += np.bincount(_OWN[np.minimum(codes[codes != 0], len(_OWN) - 1)], minlength=len(totals))
        for _, start, h in _grams(codes):
            bucket, n = np.unique(_bucket(codes, start, h), return_counts=True)
            counts[bucket] += n.astype(np.int32)
    blocks = counts.reshape(-1, BLOCK)
    at = np.flatnonzero(blocks.any(axis=1))
    for s in range(0, len(at), 4096):
        part = at[s : s + 4096]
        rows = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * BLOCK), len(part), [None, pa.py_buffer(np.ascontiguousarray(blocks[part]))])
        yield pa.RecordBatch.from_arrays([pa.array(part), rows.cast(pa.binary()), pa.nulls(len(part), pa.int64())], names=["block", "counts", "total"])
    k = np.arange(len(totals))
    yield pa.RecordBatch.from_arrays([pa.array(-1 - k), pa.nulls(len(k), pa.binary()), pa.array(totals)], names=["block", "counts", "total"])


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, n) of the buckets of the partition's blocks with LEAST substrings, and the scripts' totals."""
    sums: dict[int, np.ndarray] = {}
    for b in batches:
        for block, raw, total in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            own = np.frombuffer(raw, np.int32).astype(np.int64) if raw is not None else np.array([total])
            sums[block] = sums[block] + own if block in sums else own
    for block, own in sums.items():
        at = np.flatnonzero(own >= LEAST) if block >= 0 else np.zeros(1, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(block * BLOCK + at if block >= 0 else np.array([block])), pa.array(own[at])], names=["bucket", "n"])


_STATS = ("n", "opens", "after", "closes", "before")


def _frequent(bits):
    """(word, n, opens, after, closes, before) of what may be frequent; of a short chunk behind three 0 how often
    what follows it closes a line or stands before a blank; of a script's name behind two 0 the same
    for all its runs, behind one 0 the number of lines without a blank and the sums of their lengths and squared lengths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, np.ndarray] = {}
        known = np.unpackbits(bits.value).view(bool)

        def add(word, values):
            if word in found:
                found[word] += values
            else:
                found[word] = values

        for texts in _texts(batches):
            text, codes, opening, closing, lengths, places = _marked(texts)
            for name, values in places:
                add(name, values)
            for name, x in lengths:
                add("\0" + name, np.array([1, x, x * x, 0, 0]))
            for n, start, h in _grams(codes):
                keep = known[_bucket(codes, start, h)]
                start, h = start[keep], h[keep]
                if not len(start):
                    continue
                _, index, back = np.unique(h, return_index=True, return_inverse=True)
                o, c = opening[start], closing[start + n - 1]
                sums = np.stack([np.bincount(back, w, len(index)) for w in (np.ones(len(back)), o == 1, o == 2, c == 1, c == 2)], axis=1)
                for i, row in zip(start[index].tolist(), sums, strict=True):
                    add(text[i : i + n], row)
        if found:
            table = np.stack(list(found.values()))
            yield pa.RecordBatch.from_arrays([pa.array(list(found)), *(pa.array(table[:, k]) for k in range(5))], names=["word", *_STATS])

    return run


def learn(df: DataFrame, text: str = "text") -> Lexicon:
    """The lexicon of all texts. Two scans of the texts with spaceless scripts; the first counts substrings in buckets, the
    second what may be frequent and what stands behind short chunks. The tables have a bounded size (see SHARE)."""
    rows = cut(df.select(F.col(text).alias("text")).where(F.col("text").rlike(f"[{SPACELESS}]")), "spaceless")
    spark = df.sparkSession
    counted = cut(rows.mapInArrow(_counted, "block bigint, counts binary, total bigint").repartition("block").mapInArrow(_summed, "bucket bigint, n bigint"), "buckets")
    totals = {list(SCRIPTS)[-1 - r.bucket]: r.n for r in counted.where("bucket < 0").collect() if r.n}
    if not totals:
        return Lexicon()
    least = {k: max(LEAST, math.ceil(n * SHARE)) for k, n in totals.items()}
    limit = F.element_at(F.array(*[F.lit(least.get(k, 1 << 60)) for k in SCRIPTS]), F.expr(f"cast(bucket div {BUCKETS} as int) + 1"))
    may = np.zeros(len(SCRIPTS) * BUCKETS, bool)
    may[counted.where("bucket >= 0").where(F.col("n") >= limit).select("bucket").toArrow().column(0).to_numpy()] = True
    bits = spark.sparkContext.broadcast(np.packbits(may))
    found = rows.mapInArrow(_frequent(bits), "word string, " + ", ".join(f"{c} double" for c in _STATS))
    enough = F.lit(False)
    for k, n in least.items():
        enough |= F.col("word").rlike(f"^(?:\\x00\\x00\\x00)?[{SCRIPTS[k]}]") & (F.col("n") >= n)
    sums = found.groupBy("word").agg(*[F.sum(c).alias(c) for c in _STATS]).where(enough | F.col("word").rlike("^\\x00{1,2}[a-z]")).toArrow()
    return _lexicon(sums, totals)


def _lexicon(sums: pa.Table, totals: dict[str, int]) -> Lexicon:
    words = sums.column("word").to_pylist()
    values = np.stack([sums.column(c).to_numpy() for c in _STATS], axis=1)
    stats = dict(zip(words, values, strict=True))
    carried = {w[3:]: stats.pop(w) for w in words if w.startswith("\0\0\0")}
    every = {w[2:]: stats.pop(w) for w in words if w in stats and w.startswith("\0\0")}
    lengths = {}
    for w in [w for w in words if w in stats and w.startswith("\0")]:
        n, x, xx, _, _ = stats.pop(w)
        if n >= 20:
            lengths[w[1:]] = (x / n, max(0.2, math.sqrt(max(xx / n - (x / n) ** 2, 0))))
    right: dict[str, float] = {}
    left: dict[str, float] = {}
    for w, s in stats.items():
        if len(w) > 1:
            right[w[:-1]], left[w[1:]] = max(right.get(w[:-1], 0), s[0]), max(left.get(w[1:], 0), s[0])
    free = {w: s for w, s in stats.items() if len(w) < LONGEST and (len(w) > 1 or _CJK.match(w)) and right.get(w, 0) <= FIXED * s[0] and left.get(w, 0) <= FIXED * s[0]}
    out = Lexicon({w: math.log(totals[script(w[0])] / s[0]) for w, s in free.items() if len(w) > 1}, lengths=lengths, unknown=math.log(2 * max(totals.values())))

    def odds(k: int) -> dict[str, float]:
        """Log-odds of the places 1 (opening, closing) against 2 (at a blank inside) of each word; a script's name behind a 0
        stands for all its words that are rare."""
        found: dict[str, float] = {}
        for name, sums in every.items():
            yes, no = sums[k], sums[k + 1]
            if yes < 20 or no < 20:
                continue
            own = {w: (s[k], s[k + 1]) for w, s in free.items() if s[k] + s[k + 1] >= LEAST and script(w[0]) == name}
            # words that hold no shorter word at the same place stand for disjoint places
            shorter = (lambda w, i: w[:i]) if k == 1 else (lambda w, i: w[-i:])
            alone = [w for w in own if not any(shorter(w, i) in own for i in range(1, len(w)))]
            own["\0" + name] = (max(yes - sum(own[w][0] for w in alone), 0.0), max(no - sum(own[w][1] for w in alone), 0.0))
            for w, (a, b) in own.items():
                found[w] = float(np.clip(math.log((a + 2) / (yes + 4) / ((b + 2) / (no + 4))), -4, 4))
        return found

    out.opens, out.closes = odds(1), odds(3)
    for w, x in carried.items():
        yes, no = every.get(script(w[0]), np.zeros(5))[3:5]
        if x[0] >= LEAST and yes >= 20 and no >= 20:
            out.carries[w] = float(np.clip(math.log((x[3] + 2) / (yes + 4) / ((x[4] + 2) / (no + 4))), -4, 4))
    return out


@dataclass
class Node:
    """A possible end: ``score`` is what the reading 'ends here' gains over 'goes on'. With ``only``, that holds for a
    sentence that starts there; any other one gains ``other``. ``script`` is set where a blank of that script may end one."""

    end: int
    start: int  # of what follows
    bare: int  # the same, behind dashes and bullets
    score: float
    only: int | None = None
    other: float = 0.0
    script: str | None = None


def best_ends(nodes: list[Node], first: tuple[int, int], last: int, short, lexicon: Lexicon) -> list[int]:
    """The ends on the best path through the readings. ``first`` is (start, bare) of the whole, ``short(a, b)`` the cost of
    [a, b) as a sentence. A sentence that starts up to BACK ends earlier is weighed whole, a longer one costs nothing."""
    n = len(nodes)
    value, parent = [0.0] * (n + 2), [-1] * (n + 2)
    far, far_at = -math.inf, -1
    for v in range(n + 1):
        node = nodes[v] if v < n else None
        end = node.end if node else last
        score = node.score if node else 0.0
        usual = score if node is None or node.only is None else node.other
        if v - BACK - 1 >= -1:
            u = v - BACK - 1
            got = value[u] if u >= 0 else 0.0
            if got > far:
                far, far_at = got, u
        best, at = far + usual, far_at
        for u in range(max(-1, v - BACK), v):
            start, bare = (nodes[u].start, nodes[u].bare) if u >= 0 else first
            if start >= end:
                continue
            got = (value[u] if u >= 0 else 0.0) + (score if node and node.only is not None and node.only in (start, bare) else usual)
            name = node.script if node and node.script else nodes[u].script if u >= 0 else None
            got += lexicon.length(name, end - start) if name else short(start, end)
            if got > best:
                best, at = got, u
        value[v], parent[v] = best, at
    out, v = [], parent[n]
    while v >= 0:
        out.append(nodes[v].end)
        v = parent[v]
    return out[::-1]
