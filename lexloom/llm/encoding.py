"""Text decoded with the wrong encoding: found by learned transformations, and restored."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.session import cut

#: Encodings among which transformations are sought: a text's bytes, and what they were taken for.
WRITTEN = ("utf-8", "cp1252", "cp1251", "mac_roman", "koi8-r", "cp866")
READ = ("cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1251", "cp1250", "koi8-r", "cp866", "gbk")
#: Slots of twins that must show a transformation before it is applied.
SUPPORT = 3
#: How many times as frequent as the token found a token restored from single bytes must be.
RATIO = 3.0
#: Copies of the table of frames: a frequent frame is looked up in as many partitions.
_SALT = 16

#: Blanks that may be meant although no token shows them: tokens are cut at some of them.
_BLANKS = frozenset("\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")

_ASCII_BLANK = r" \t\r\n\u2009\u3000"
_TOKEN = f"[^{_ASCII_BLANK}]*[^\\x00-\\x7F{_ASCII_BLANK}][^{_ASCII_BLANK}]*"
_OUTER = "[!-/:-@\\[-`{-~]+"


def _byte_tables() -> dict[str, dict[str, int]]:
    """Character to byte of each single-byte encoding; bytes without a character stand for themselves, as lenient
    decoders have it."""
    tables = {}
    for name in {*WRITTEN, *READ} - {"utf-8", "gbk"}:
        t = {}
        for b in range(128, 256):
            try:
                t[bytes([b]).decode(name)] = b
            except UnicodeDecodeError:
                t[chr(b)] = b
        tables[name] = t
    return tables


def _to_bytes(text: str, name: str, tables: dict) -> bytes | None:
    if name in ("gbk", "utf-8"):
        try:
            return text.encode(name)
        except UnicodeEncodeError:
            return None
    t = tables[name]
    out = bytearray()
    for c in text:
        b = ord(c) if c < "\x80" else t.get(c)
        if b is None:
            return None
        out.append(b)
    return bytes(out)


def _from_bytes(raw: bytes, name: str, backs: dict) -> str | None:
    if name in ("gbk", "utf-8"):
        try:
            return raw.decode(name)
        except UnicodeDecodeError:
            return None
    return "".join(chr(b) if b < 128 else backs[name][b] for b in raw)


def _clean(c: str) -> bool:
    """Whether a character may be the outcome of a restoration."""
    return c < "\x80" and c.isprintable() or c > "\x9f" and c != "�" and unicodedata.category(c) not in ("Cc", "Cs", "Co", "Cn")


def _explained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each clean run and what stands in its place, the (written, read) encodings that turn one into the other."""
    tables = _byte_tables()
    backs = {k: {b: c for c, b in t.items()} for k, t in tables.items()}
    schema = pa.schema([("written", pa.string()), ("read", pa.string()), ("garbled", pa.string()), ("n", pa.int64())])
    for b in batches:
        rows = []
        for x, y, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            if not all(map(_clean, x)):
                continue
            for w in WRITTEN:
                raw = _to_bytes(x, w, tables)
                if raw is None:
                    continue
                for r in READ:
                    if r != w and _from_bytes(raw, r, backs) == y:
                        rows.append((w, r, y, n))
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema=schema)


def _utf8_pattern(read: str, tables: dict) -> re.Pattern:
    """Stretches of ``read`` whose bytes have the form of a UTF-8 character."""
    kind = lambda lo, hi: "[" + "".join(re.escape(c) for c, b in tables[read].items() if lo <= b < hi) + "]"
    tail = kind(0x80, 0xC0)
    return re.compile(f"{kind(0xC2, 0xE0)}{tail}|{kind(0xE0, 0xF0)}{tail}{{2}}|{kind(0xF0, 0xF5)}{tail}{{3}}")


def _likely(word: str) -> bool:
    """Whether a word of single bytes may be meant: letters of one script, capitals at its start or throughout."""
    core = "".join(filter(str.isalpha, word))
    one = all("\u0400" <= c <= "\u04ff" for c in core) or all(c < "\u0250" for c in core)
    return bool(core) and one and (core.islower() or core.isupper() or core.istitle())


def _candidates(learned: list[tuple[str, str]], alphabet: set[str]):
    """(token, restored, sure, how) for each token that some transformation explains: the learned ones, and for words
    without any ASCII letter, which have no twins, all of single bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = _byte_tables()
        backs = {k: {b: c for c, b in t.items()} for k, t in tables.items()}
        multi = [(r, _utf8_pattern(r, tables)) for w, r in learned if w == "utf-8" and r != "gbk"]
        gbk = ("utf-8", "gbk") in learned
        every = [(w, r) for w in WRITTEN for r in READ if w != r and w != "utf-8" and r != "gbk"]
        maps = {(w, r): (frozenset(tables[r]), {ord(c): backs[w][b] for c, b in tables[r].items()}) for w, r in every}
        single = [k for k in learned if k in maps]
        schema = pa.schema([("token", pa.string()), ("restored", pa.string()), ("sure", pa.bool_()), ("how", pa.string())])
        plain = frozenset("“”‘’„‚«»…–—")

        def meant(m: re.Match, read: str) -> str:
            try:
                c = bytes(tables[read][x] for x in m.group()).decode("utf-8")
            except UnicodeDecodeError:
                return m.group()
            return c if c in alphabet and _clean(c) else m.group()

        def once(t: str) -> str:
            for r, pattern in multi:
                if pattern.search(t) and (got := pattern.sub(lambda m, r=r: meant(m, r), t)) != t:
                    return got
            if gbk and any("\u4e00" <= c <= "\u9fff" for c in t):
                raw = _to_bytes(t, "gbk", tables)
                got = raw and _from_bytes(raw, "utf-8", backs)
                if got and all(c in alphabet for c in got if c > "\x7f"):
                    return got
            return t

        for b in batches:
            rows = []
            for t in b.column(0).to_pylist():
                # replacement marks and C1 controls only come from decoding
                broken = any(c == "\ufffd" or "\x80" <= c <= "\x9f" for c in t)
                got, last = once(t), t
                while got != last:  # decoded wrongly several times; each round is shorter than the last
                    last, got = got, once(got)
                own = {c for c in t if c > "\x7f"}
                bare = sum(map(str.isalpha, t)) >= 4 and not any("a" <= c <= "z" or "A" <= c <= "Z" for c in t)
                if got != t or broken:
                    rows.append((t, got, True, ""))
                    if not bare:
                        continue
                if own <= plain and not any(c.isalnum() for c in t):
                    continue
                for k in every if bare else single:
                    chars, table = maps[k]
                    if own <= chars and (got := t.translate(table)) != t and all(map(_clean, got)) and (not bare or _likely(got)):
                        rows.append((t, got, False, " ".join(k)))
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema=schema)

    return run


def _merged(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that is never broadcast: Spark takes the size of compressed files for that of their rows,
    and the driver would hold many times as much. For tables that grow with the vocabulary."""
    return df.hint("merge")


def _form(token: Column) -> Column:
    """A token's frame: its ASCII words and numbers reduced to marks, so that quotes, dashes and signs can be counted
    whatever word they stand at. What follows an apostrophe is kept: only some endings do."""
    return F.regexp_replace(F.regexp_replace(token, "(?<![A-Za-z’])[A-Za-z]+(?:'[A-Za-z]+)*", "w"), "[0-9]+", "0")


def _slots(counted: DataFrame) -> DataFrame:
    """(token, n, twin, slot, run): the runs of non-ASCII characters of tokens with two ASCII letters or more; twins are
    equal without them."""
    pieces = F.split(F.lower("token"), r"[^\x00-\x7F]+")
    rows = counted.where(F.length(F.regexp_replace("token", "[^A-Za-z]+", "")) >= 2)
    return rows.select("token", "n", F.xxhash64(pieces).alias("twin"), F.posexplode(F.regexp_extract_all("token", F.lit(r"[^\x00-\x7F]+"), F.lit(0))).alias("slot", "run"))


def garbled_tokens(df: DataFrame, id: str = "case_id", text: str = "prefix") -> tuple[DataFrame, DataFrame]:
    """(id, token) of the tokens with non-ASCII characters, and (token, restored, kind) of the garbled ones; what cannot
    be restored is given as it is. ``kind`` tells the evidence: 'twin' (a clean twin of the token was found), 'learned'
    (a transformation learned from twins), 'scripts' (one that gave known words in scripts without twins), 'mark' (a
    replacement mark or C1 control, which only wrong decoding leaves) or 'prior' (UTF-8 read as cp1252, the one
    transformation that is tried even if no twin shows it).

    Twins are words that are equal without their non-ASCII characters (whole texts have twins too seldom). Of the runs
    that fill one slot of twins the most frequent one is taken as clean, the others are aligned with it; such pairs tell
    which encodings were confused, and transformations with SUPPORT rows and two different runs are learned. They are applied
    to every token of every text: a UTF-8 sequence read as single bytes betrays itself. A single byte is restored only
    if the outcome is RATIO times as frequent as the token, as a word or in its frame, never where the token has the
    usual run of its own slot, and between letters only if what stands around is known words.
    """
    rows = df.select(F.col(id).cast("bigint").alias("id"), F.col(text).alias("text")).where(F.col("id").isNotNull() & F.col("text").rlike(r"[^\x00-\x7F]"))
    trimmed = F.regexp_replace(F.col("token"), f"^{_OUTER}|{_OUTER}$", "")
    tokens = cut(rows.select("id", F.explode(F.regexp_extract_all("text", F.lit(_TOKEN), F.lit(0))).alias("token")).select("id", trimmed.alias("token")), "tokens")
    counted = cut(tokens.groupBy("token").agg(F.count("*").alias("n")), "counted")

    slots = cut(_slots(counted), "slots")
    runs = slots.groupBy("twin", "slot", "run").agg(F.sum("n").alias("n"))
    usual = cut(runs.groupBy("twin", "slot").agg(F.max_by(F.struct("run", "n"), F.struct("n", "run")).alias("u")).select("twin", "slot", F.col("u.run").alias("clean"), F.col("u.n").alias("times")), "usual")
    pairs = runs.join(_merged(usual), ["twin", "slot"]).where("run <> clean").groupBy("clean", "run").agg(F.sum("n").alias("n"))
    known = counted.select(F.explode(F.array_distinct(F.split("token", ""))).alias("c"), "n").where(r"c rlike '[^\\x00-\\x7F]'").groupBy("c").agg(F.sum("n").alias("n")).where(f"n >= {SUPPORT}")
    # both are small whatever the data: pairs of encodings, and code points
    found = pairs.mapInArrow(_explained, "written string, read string, garbled string, n bigint").groupBy("written", "read").agg(F.sum("n").alias("n"), F.count("*").alias("kinds")).where(f"n >= {SUPPORT} and kinds >= 2").orderBy(F.desc("n"), "written", "read").collect()
    learned = [(r.written, r.read) for r in found]
    prior = [] if ("utf-8", "cp1252") in learned else [("utf-8", "cp1252")]
    alphabet = {r.c for r in known.collect()} | _BLANKS | {chr(c) for c in (*range(0xA0, 0x100), 0x2013, 0x2014, *range(0x2018, 0x201F), 0x2020, 0x2021, 0x2022, 0x2026, 0x2030, 0x2039, 0x203A, 0x20AC, 0x2122)}

    proposed = cut(counted.select("token").mapInArrow(_candidates(learned + prior, alphabet), "token string, restored string, sure boolean, how string"), "proposed")
    sure = proposed.where("sure").select("token", "restored", F.when(F.expr("restored = token"), "mark").otherwise("prior" if prior else "learned").alias("kind"))
    words = counted.groupBy(F.lower("token").alias("w")).agg(F.sum("n").alias("n"))
    # a frame may stand for a large share of all tokens: its count is looked up in several places
    forms = cut(counted.groupBy(_form(F.col("token")).alias("f")).agg(F.sum("n").alias("n")), "forms").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALT - 1))))
    rest = proposed.where("not sure").select("token", "restored", "how", F.lower("token").alias("w0"), F.lower("restored").alias("w1"), _form(F.col("token")).alias("f0"), _form(F.col("restored")).alias("f1"), F.pmod(F.xxhash64("token"), F.lit(_SALT)).cast("int").alias("salt"))
    for side in ("0", "1"):
        rest = rest.join(_merged(words.select(F.col("w").alias(f"w{side}"), F.col("n").alias(f"nw{side}"))), f"w{side}", "left").join(_merged(forms.select("salt", F.col("f").alias(f"f{side}"), F.col("n").alias(f"nf{side}"))), [f"f{side}", "salt"], "left")
    rest = cut(rest.fillna(0, ["nw0", "nw1", "nf0", "nf1"]), "rest")
    # what is usual in its own slot is right as it stands
    settled = slots.join(_merged(usual), ["twin", "slot"]).groupBy("token").agg(F.min(F.expr(f"run = clean and times >= {SUPPORT}")).alias("settled")).where("settled").select("token")
    rest = rest.join(_merged(settled), "token", "left_anti")
    # a frame says something only if the characters in question are not inside a word
    framed = F.col("f1").rlike("^[^\\p{L}\\p{M}]*(?:w[^\\p{L}\\p{M}]*)*$") | F.col("f1").rlike("^[^\\p{L}\\p{M}]*(?:w[^\\p{L}\\p{M}]*)*’[a-z]+[^\\p{L}\\p{M}]*$") | F.col("f1").rlike("^[^\\p{L}]*0[^\\p{L}]*$")
    framed &= F.col("nf1") >= SUPPORT
    rest = rest.withColumn("inner", F.when(framed & F.col("token").rlike(r"[A-Za-z][^\x00-\x7F]+[A-Za-z]"), F.split(F.regexp_replace(F.lower("restored"), "’[a-z]{1,2}(?![a-z])", ""), "[^a-z]+")))
    parts = rest.select("token", "restored", F.explode("inner").alias("w")).where("w <> ''")
    spelled = rows_of_words(df, text).groupBy("w").agg(F.count("*").alias("n")).where(f"n >= {SUPPORT}")
    strange = parts.join(_merged(spelled), "w", "left_anti").select("token", "restored").distinct()
    rest = rest.join(_merged(strange.withColumn("strange", F.lit(True))), ["token", "restored"], "left")
    score = F.greatest(F.when(F.col("nw1") >= SUPPORT, F.col("nw1") / F.greatest("nw0", F.lit(1))), F.when(framed & F.col("strange").isNull(), F.col("nf1") / F.greatest("nf0", F.lit(1))))
    scored = cut(rest.withColumn("score", score).where(F.col("score") >= RATIO), "scored")
    # a transformation that no twin showed counts once it gave SUPPORT known words
    hows = scored.where(f"nw1 >= {SUPPORT} and not token rlike '[A-Za-z]'").groupBy("how").agg(F.countDistinct("restored").alias("n")).where(f"n >= {SUPPORT}").collect()
    shown = [f"{w} {r}" for w, r in learned]
    allowed = sorted({r.how for r in hows} | set(shown))
    best = scored.where(F.col("how").isin(allowed)).groupBy("token").agg(F.max_by(F.struct("restored", "how"), F.struct("score", "restored")).alias("b")).select("token", "b.restored", F.when(F.col("b.how").isin(shown), "learned").otherwise("scripts").alias("kind"))
    bad = cut(best.unionAll(sure.join(_merged(best), "token", "left_anti")), "bad")
    # a twin is the restored word itself among the tokens, and usual in its slots
    twins = bad.where("kind in ('learned', 'prior')").join(_merged(counted.where(f"n >= {SUPPORT}").select(F.col("token").alias("restored"))), "restored", "left_semi").select("token").distinct().withColumn("twin", F.lit(True))
    return tokens, bad.join(_merged(twins), "token", "left").select("token", "restored", F.when(F.col("twin"), "twin").otherwise(F.col("kind")).alias("kind"))


def rows_of_words(df: DataFrame, text: str) -> DataFrame:
    """(w): every word of ASCII letters only, in small letters, as often as it occurs."""
    return df.where(F.col(text).isNotNull()).select(F.explode(F.split(F.lower(F.col(text)), r"[^\p{L}\p{M}]+")).alias("w")).where("w rlike '^[a-z]+$'")


def garbled(df: DataFrame, id: str = "case_id", text: str = "prefix") -> DataFrame:
    """(case_id): rows with a garbled sequence. Null and ASCII-only texts are no cases."""
    tokens, bad = garbled_tokens(df, id, text)
    return tokens.join(_merged(bad), "token", "left_semi").select(F.col("id").alias("case_id")).distinct()


def restored(df: DataFrame, id: str = "case_id", text: str = "prefix") -> DataFrame:
    """(case_id, restored, whole): the garbled rows with their tokens restored; ``whole`` tells that nothing broken is left.

    A text is cut at the borders of its tokens and each token is looked up once, so that no part of a clean word and no
    earlier outcome is touched.
    """
    tokens, bad = garbled_tokens(df, id, text)
    hits = tokens.join(_merged(bad), "token")
    fixes = hits.groupBy("id").agg(F.collect_set(F.when(F.expr("token <> restored"), F.struct("token", "restored"))).alias("fixes"))
    rows = df.select(F.col(id).cast("bigint").alias("id"), F.col(text).alias("text")).where(F.col("text").rlike(r"[^\x00-\x7F]"))
    chunks = F.regexp_extract_all("text", F.lit(f"[{_ASCII_BLANK}]+|[^{_ASCII_BLANK}]+"), F.lit(0))
    out = rows.join(_merged(fixes), "id").withColumn("fixes", F.map_from_entries("fixes")).withColumn("chunks", chunks)

    def fixed(c: Column) -> Column:
        meant = F.element_at("fixes", F.regexp_replace(c, f"^{_OUTER}|{_OUTER}$", ""))
        return F.when(meant.isNull(), c).otherwise(F.concat(F.regexp_extract(c, f"^(?:{_OUTER})?", 0), meant, F.regexp_extract(c, f"(?:{_OUTER})?$", 0)))

    out = out.select(F.col("id").alias("case_id"), F.array_join(F.transform("chunks", fixed), "").alias("restored"))
    return out.withColumn("whole", ~F.col("restored").rlike("[\u0080-\u009f�]"))


def evidence(df: DataFrame, id: str = "case_id", text: str = "prefix") -> DataFrame:
    """(kind, cases): the garbled rows by the strongest evidence of any of their tokens: 'twin', 'learned', 'scripts',
    'mark', 'prior' in this order."""
    tokens, bad = garbled_tokens(df, id, text)
    order = F.array(*[F.lit(k) for k in ("twin", "learned", "scripts", "mark", "prior")])
    hits = tokens.join(_merged(bad), "token").groupBy("id").agg(F.min(F.array_position(order, F.col("kind"))).alias("at"))
    return hits.groupBy(F.element_at(order, F.col("at").cast("int")).alias("kind")).agg(F.count("*").alias("cases"))
