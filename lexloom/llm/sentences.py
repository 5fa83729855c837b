"""Sentences of documents in spaced and spaceless scripts, as code point offsets: every terminator or blank that may end
one is a node with two readings, what stands around it tells for and against an end, and the best path is taken."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lexloom.llm.lattice import BEFORE, SPACELESS, Lexicon, Node, best_ends, learn, script
from lexloom.session import by_value

#: Abbreviations that seldom end a sentence: titles, references, "that is", units that a number or name follows.
NEVER = frozenset(
    "mr mrs ms dr prof capt lt col gen sgt rev hon st mt no nos fig figs vol vols ch chap p pp sec eq ed eds cf vs viz al approx incl excl ca i.e e.g inc co u.s u.k dept est "
    "sr sra srta dra dña av avda núm pág ej m mm mme mlle mgr ex env "
    "z b z.b d.h u.a bzw ggf evtl sog vgl nr str hr fr frau abs bd "
    "dhr mevr mw bijv a.d d.w.z o.a blz "
    "т е т.е д т.д г гг тыс млн млрд руб ул рис стр им др см "
    "डॉ श्री सुश्री प्रो د أ ดร".split()
)
#: Of these, the ones that always go on: a name, an explanation or a number follows, whatever its capital.
FIRM = frozenset(
    "mr mrs ms dr prof capt lt col gen sgt rev hon mt cf vs viz approx incl excl ca i.e e.g "
    "sra srta dra dña av avda ej m mme mlle mgr ex env z.b d.h u.a bzw ggf evtl sog vgl hr fr abs "
    "dhr mevr mw bijv a.d d.w.z o.a т.е им др डॉ श्री सुश्री प्रो د أ ดร".split()
)
#: Of these, the ones that are also words, or that only a number follows.
PLAIN = frozenset("no nos fig figs vol vols chap sec eq nr núm pág frau est mm рис стр см".split())
#: Words that, with a capital, open a sentence and are no name.
OPENING = frozenset(
    "a the this that these those he she it they we you i his her its their our my your there then here when while if but so now later after before at in on for from with what why how where yes no not nobody everyone many most all both "
    "der die das den dem ein eine er sie es wir ihr ich man dann da dort hier heute gestern morgen aber wenn als nach vor im am auf für mit diese dieser nun jetzt "
    "le la les un une il elle ils elles nous vous je ce cette ces puis alors demain mais quand dans après avant "
    "el él ella ellos ellas los las yo entonces luego después ayer hoy mañana pero cuando si en por "
    "de het een hij zij ze wij ik daarna toen maar gisteren vandaag "
    "он она оно они мы вы я это этот эта эти там тогда потом затем но а и вчера сегодня завтра если когда в на после".split()
)
#: Of these, the ones that open surnames as well: after a single letter they tell nothing.
_SURNAME = frozenset("le la les der die den dem das de el los las da so no in on".split())
#: Abbreviations that end one if what follows looks like an opening.
MAY = frozenset("a.m p.m corp ltd jr etc usw ph.d m.d b.a coop plc etc коп uhr".split())
#: Words that never open a sentence, so that a mark before them is part of a name or an aside.
GOES_ON = frozenset("and or of said says asked shouted replied whispered cried added that which who if fragte sagte rief dit demanda répondit preguntó dijo vroeg zei riep спросил сказал ответил".split())
SPEECH = frozenset(
    "said says asked asks shouted shouts replied whispered cried added answered yelled muttered "
    "fragte sagte rief antwortete meinte dit demanda répondit cria ajouta preguntó dijo respondió gritó añadió vroeg zei riep antwoordde "
    "спросил спросила сказал сказала ответил ответила крикнул добавил".split()
)
_MONTHS = frozenset("januar februar märz april mai juni juli august september oktober november dezember jänner".split())
_BEFORE_DAY = frozenset("am vom zum den der dem im bis ab seit".split())

#: Common words that a single letter follows as a name: "plan B".
LETTERED = frozenset("plan vitamin type class group hepatitis section option part point grade team exhibit figure appendix room version block gate level planet".split())

_EMOJI = "[\U0001f000-\U0001faff☀-➿⭐⭕️\u200d\U0001f3fb-\U0001f3ff]"
_SMILE = r"(?:[:;=8][-^o]?[)(\]\[DdPp3]+|<3|\^\^)(?!\w)"
#: What may follow a final mark and belongs to it.
_TAIL = re.compile(rf"(?:[\s]*(?:{_EMOJI}|{_SMILE}))+")
_MARK = re.compile(r"[.!?…。！？؟।॥｡．‼⁇⁈⁉۔]+|[“”„«»‘’‚‹›\"'()\[\]（）【】「」『』《》]")
_STOPS = frozenset(".!?…。！？؟।॥｡．‼⁇⁈⁉۔")
_WIDE = frozenset("。！？｡．")
_CLOSES = {"“": "”", "„": "“”", "«": "»", "»": "«", "‘": "’", "‚": "‘’", "‹": "›", '"': '"', "'": "'", "(": ")", "[": "]", "（": "）", "【": "】", "「": "」", "『": "』", "《": "》"}
_OPENS = {c: tuple(o for o, closing in _CLOSES.items() if c in closing) for c in "".join(_CLOSES.values())}
_BRACKETS = frozenset("([（【")
_ITEM = re.compile(r"\s*(?:[-*•‣▪·–—+]\s+|\(?\d{1,3}[.)]\s+|\(?[a-z]\)\s+)")
_MESSAGE = re.compile(r"[@#]\w|(?i:rt) @|[A-Z]\w{0,15}: ")
_TAGGED = re.compile(r"[@#]\w+[.!?…]*|https?://\S+")
_SPACELESS = re.compile(f"[{SPACELESS}]")
_CJK = re.compile(r"[぀-ヿ㐀-鿿豈-﫿]")
_WIDE_MARK = re.compile("[\u3000-\u303f\uff01-\uff60]")
_BLANK = re.compile(r"\s*")
_BARE = re.compile(r"[\s\-—–*•]*")
_ANY = re.compile(r"[^\W_]")
_SHORT, _INITIAL, _DAY = re.compile(r"(?:[^\W\d_]\.)*[^\W\d_]"), re.compile(r"[^\W\d_]\."), re.compile(r"\d{1,2}")
_LINE = re.compile(r"[^\n\r  \x0b\x0c]+")

def _lines(text: str) -> list[tuple[int, int]]:
    """Lines with non-blank characters."""
    return [(m.start(), m.end()) for m in _LINE.finditer(text) if not m.group().isspace()]


def _cells(text: str) -> int:
    """Columns that a text takes: two for each ideograph or kana."""
    return len(text) + len(_CJK.findall(text)) + len(_WIDE_MARK.findall(text))


def _wraps(text: str, lines: list[tuple[int, int]], breaks: list[int], lens: list[int], width: int) -> set[int]:
    """The breaks that wrap running text of ``width`` columns; none if too few stand where the next word no longer fitted."""
    wraps, forced, inside, lower, wide, plain, messages = set(), 0, 0, 0, 0, 0, 0
    for k in breaks:
        (a, b), (c, e) = lines[k], lines[k + 1]
        nxt = text[c:e].lstrip()
        if _ITEM.match(nxt):
            continue
        plain += 1
        message = bool(_MESSAGE.match(nxt) or _TAGGED.fullmatch(text[a:b].rsplit(None, 1)[-1]))
        messages += message
        last = text[a:b].rstrip()[-1]
        word = nxt.split(None, 1)[0]
        if _CJK.match(last) or _WIDE_MARK.match(last) or _CJK.match(nxt):
            need, dense = 4, True  # a mark that may not open a line takes its neighbour along
        elif _SPACELESS.match(last) or _SPACELESS.match(nxt):
            need, dense = min(len(word), 10), True
        else:
            need, dense = 1 + len(word), False
        if lens[k] + need > width:
            forced += 1
            wraps.add(k)
            if last not in ".!?…:”»\")']।؟。！？：」』":
                inside += 1
                wide += dense
                lower += not dense and nxt[0].islower() and not message
    if not forced or forced < 0.8 * plain or messages > 0.3 * plain:
        return set()
    if width < 50 or wide > 0.5 * inside:  # short lines, or no small letters, tell less
        told = forced >= 3 and forced >= 0.95 * plain and inside >= 0.5 * forced and width >= 24 and lower + wide >= 0.5 * inside
    else:
        told = lower or inside >= 5 and inside >= 0.5 * forced
    return wraps if told else set()


def _blocks(text: str) -> list[tuple[int, int]]:
    """Lines, joined where a break only wraps running text: nearly every break of the text stands where the next word no
    longer fitted, and most stand inside a sentence."""
    lines = _lines(text)
    breaks = [k for k in range(len(lines) - 1) if text.count("\n", lines[k][1], lines[k + 1][0]) == 1]
    if not breaks:
        return lines
    lens = [_cells(text[a:b].rstrip()) for a, b in lines]
    # some lines may be longer than the text was wrapped at
    for width in dict.fromkeys((max(lens), sorted(lens)[-1 - max(1, len(lens) // 10)])):
        if wraps := _wraps(text, lines, breaks, lens, width):
            out = [list(lines[0])]
            for k in range(1, len(lines)):
                if k - 1 in wraps:
                    out[-1][1] = lines[k][1]
                else:
                    out.append(list(lines[k]))
            return [tuple(x) for x in out]
    return lines


def _pairs(text: str, a: int, b: int, marks: list[tuple[int, str]]) -> dict[int, int]:
    """For each opening quote or bracket of a block, its closing one. What is never closed opens nothing."""
    pairs: dict[int, int] = {}
    stack: list[tuple[int, str]] = []
    at: dict[str, list[int]] = {}  # where each kind of opening mark stands on the stack
    for i, ch in marks:
        before, after = text[i - 1] if i > a else " ", text[i + 1] if i + 1 < b else " "
        k = max((at[o][-1] for o in _OPENS.get(ch, ()) if at.get(o)), default=None)
        if k is not None and ch in "'’\"":
            # an apostrophe is no closing quote, nor is a mark that opens a word
            if (ch != '"' and after.isalnum() and not _CJK.match(after)) or before.isspace() and not after.isspace() and ch != "’":
                k = None
        if k is not None:
            pairs[stack[k][0]] = i
            while len(stack) > k:
                at[stack.pop()[1]].pop()
            continue
        if ch in "'‘\"" and not ((before.isspace() or before in "([—–-:,“«") and not after.isspace()):
            if ch != '"' or before.isalnum():
                continue
        if ch == "»" or ch == "‘" and before.isalnum() or ch not in _CLOSES:
            continue
        at.setdefault(ch, []).append(len(stack))
        stack.append((i, ch))
    return pairs


_LEADING = "(\"'“„«‘[¿¡—–- "
_CHUNK = re.compile(r"\S+")
_TO_COMMA = re.compile("[^。！？…，、；：“「\n]*")


def _token(text: str, a: int, i: int) -> tuple[str, int]:
    """The chunk that ends before i, in small letters and without opening marks, and where it starts."""
    s = i
    while s > a and not text[s - 1].isspace():
        s -= 1
    return text[s:i].lstrip("(\"'“„«‘[¿¡—-").lower(), s


def _before(text: str, a: int, s: int) -> str:
    """The chunk before the blanks that end at s."""
    while s > a and text[s - 1].isspace():
        s -= 1
    return _token(text, a, s)[0]


def _attributed(text: str, near: int, b: int) -> bool:
    """Whether what follows a quotation, from its first word on, attributes it."""
    first = text[near]
    if first in ",;—–-" or first.islower():
        if first in "—–-":
            m = _CHUNK.search(text, near + 1, b)
            return not m or m.group()[0].islower() or m.group().lower() in SPEECH
        return True
    if text.startswith(("라고", "이라고", "고 ", "と", "って"), near, b):
        return True
    if _CJK.match(first):
        return _TO_COMMA.match(text, near, b).group().endswith(("说", "问", "道", "喊", "叫", "言った", "聞いた", "尋ねた"))
    words = [m.group() for m, _ in zip(_CHUNK.finditer(text, near, b), range(5), strict=False)]
    if "ने" in words[1:3]:
        at = words.index("ने") + 1
        return at < len(words) and words[at].rstrip("।.!?") in ("पूछा", "कहा", "बताया", "बोला")
    for w in words[:4]:
        bare = w.strip(".,!?;:").lower()
        if bare in SPEECH:
            return not w.endswith(":")  # it introduces the next quotation
        if not w[:1].isupper() or w[-1] in ".!?":
            return False
    return False


def _abbreviation(token: str, led: bool, lettered: bool, lead: str) -> float:
    """What an abbreviation or letter before a full stop takes from the reading that the sentence ends, and what follows
    (``lead``, without opening marks) gives back. ``led`` tells that a letter with a full stop stands before the token,
    ``lettered`` that the word before it takes letters as names."""
    if token in FIRM:
        return -6.0
    word = re.match(r"[^\s,.!?;:]*", lead).group()
    if not word[:1].isupper():
        return -4.0
    opening = word.lower() in OPENING
    if token in PLAIN:
        return -4.0 if re.match(r"(?:[IVXLC]+|[A-Z])\b", word) and not opening else -1.0
    if len(word) == 1 and lead[1:2] == ".":  # an initial
        return -4.0
    if len(token) == 1:
        if lettered:
            return -1.0
        return -1.0 if opening and not led and word.lower() not in _SURNAME else -3.0
    return -1.0 if opening else -3.0


def _cased(block: str) -> bool:
    """Whether the case of letters tells anything in this block."""
    lower, upper = block.lower(), block.upper()
    if (block in (lower, upper) or len(block) < 40) and sum(x != y for x, y in zip(lower, upper, strict=False)) < 12:
        return True
    if block in (lower, upper):
        return False
    words = block.split()
    return 4 * sum(1 for w in words if len(w) > 3 and (t := w[1:]) != t.lower() and t != t.upper()) < len(words)


def _nodes(text: str, a: int, b: int, lexicon: Lexicon) -> list[Node]:
    """The terminators of the block [a, b) with what speaks for an end at each: above 0 it ends, below it goes on."""
    marks = [(m.start(), m.group()) for m in _MARK.finditer(text, a, b)]
    if not marks:
        return []
    pairs = _pairs(text, a, b, [m for m in marks if m[1] in _CLOSES or m[1] in "”’»)]）】」』》›"])
    nodes: list[Node] = []
    # where the next mark stands that may end a sentence
    stops, stop = [b] * len(marks), b
    for k in range(len(marks) - 1, -1, -1):
        stops[k] = stop
        i, mark = marks[k]
        if mark[0] in _STOPS and (i + len(mark) >= b or not text[i + len(mark)].isalnum()):
            stop = i
    cased = None
    start = a  # behind the last likely end
    item = _ITEM.match(text, a, b)
    skip = item.end() if item else a

    def add(end: int, score: float, only: int | None = None, other: float = 0.0) -> None:
        nonlocal start
        near = _BLANK.match(text, end, b).end()
        nodes.append(Node(end, near, _BARE.match(text, near, b).end(), score, only, other))
        if (other if only is not None and only != nodes[-2].bare and only != nodes[-2].start else score) > 0 if len(nodes) > 1 else score > 0:
            start = near

    for k, (i, mark) in enumerate(marks):
        if i < skip:
            continue
        if i in pairs:  # nothing ends inside quotations and brackets
            j = pairs[i]
            skip = j + 1
            last = j - 1
            while last > i and text[last].isspace():
                last -= 1
            if last <= i or text[last] not in ".!?…。！？؟।":
                continue
            end = j + 1
            while end < b and text[end] in "”’\"'»)」』":
                end += 1
            tail = _TAIL.match(text, end, b)
            end = tail.end() if tail else end
            near = _BLANK.match(text, end, b).end()  # however far the next word is
            if near >= b:
                continue
            first = text[near]
            if mark in _BRACKETS:
                add(end, 3.0 if near > end else -3.0, i, -3.0)
                continue
            if near == end and not _CJK.match(first) and first not in "“「『《（":
                continue
            before = i
            while before > start and text[before - 1].isspace():
                before -= 1
            # a speaker's label introduces no quotation
            introduced = before > start and text[before - 1] in ":：" and _token(text, start, before)[1] > start
            if _attributed(text, near, b) and not (introduced and first.isupper()):
                add(end, -4.0)
                continue
            other = 3.0
            if before > start and text[before - 1] not in ":,：，—–-" and not _CJK.match(first) and text[last] != ".":
                if cased is None:
                    cased = _cased(text[a:b])
                if first.islower() or not cased:
                    other = -3.0
            add(end, 3.0, i, other)
            continue
        if mark[0] in _CLOSES or mark in "”’»)]）】」』》›":
            continue
        end = i + len(mark)
        while end < b and text[end] in "”’\"'»)]）」』" and end not in pairs:
            end += 1
        tail = _TAIL.match(text, end, b)
        end = tail.end() if tail else end
        if end >= b:
            continue
        nxt = text[end]
        if mark[0] in _WIDE or mark[0] in "…" and _CJK.match(nxt):
            add(end, 6.0)
            skip = end
            continue
        if not nxt.isspace():
            if mark[-1] in "!?" and (nxt in "“「«„" or nxt.isupper() and text[i - 1].islower()) or mark[-1] in "।॥؟":
                add(end, 3.0)
                skip = end
            continue
        near = _BLANK.match(text, end, b).end()
        if near >= b:
            continue
        if cased is None:
            cased = _cased(text[a:b])
        # what follows up to the next mark may be all in small letters
        stop = max(stops[k], near)
        following = text[near:stop]
        telling = cased and not (following.islower() and len(following.split()) > 5)
        lead = following.lstrip(_LEADING) or text[near : near + 1]
        first = lead[:1]
        word = re.match(r"[^\s,.!?;:]*", following).group().lower()
        score = 2.0
        if word in GOES_ON or text[near] in ",;:)»" or text[near] in "—–-" and first.islower():
            score -= 6.0
        if mark == ".":
            token, s = _token(text, start, i)
            if token in MAY or token == "h" and _before(text, start, s)[-1:].isdigit():
                pass
            elif token in NEVER or _SHORT.fullmatch(token) and not _CJK.match(token):
                previous = _before(text, start, s)
                whole = lead + text[stop : stop + 1]
                score += _abbreviation(token, bool(_INITIAL.fullmatch(previous)), previous in LETTERED, whole) if telling else -4.0
            elif _DAY.fullmatch(token) and (word in _MONTHS or _before(text, start, s) in _BEFORE_DAY):
                score -= 6.0
        spaced = i > a and text[i - 1].isspace() and mark[0] in ".…" and (len(mark) > 1 or mark == "…")
        if telling and first.islower() or spaced and (not telling or first.islower()):
            score -= 6.0
        add(end, score)
        if score > 0:
            skip = end
    return nodes


def _gaps(text: str, a: int, b: int, lexicon: Lexicon) -> list[Node]:
    """The blanks of spaceless scripts, classified by the words on both sides."""
    nodes = []
    chunks = [m.span() for m in _CHUNK.finditer(text, a, b)]
    behind = ""
    titled = None  # where a title opens what stands before the gap, if nothing but a name follows it
    for (p, i), (j, q) in zip(chunks, chunks[1:], strict=False):
        left, right = text[p:i], text[j:q]
        titled, opened = (p if left in BEFORE else None), titled
        behind, before = left, behind
        own = _SPACELESS.search(left) or _SPACELESS.search(right)
        if not own or left[-1] in "，、；：,;:" or right[0] in "，、；：,;:)]）」』”’":
            continue
        score = 1.0
        if _SPACELESS.match(right):
            score += lexicon.opening(right)
        else:
            score -= 3.0 if right[0].isdigit() else 1.2
        if _SPACELESS.match(left[-1]) or left[-1] == ".":
            score += lexicon.closing(left)
        else:
            score -= 2.0 if left[-1].isdigit() else 1.2
        score += lexicon.carries.get(before, -2.0 * (before in BEFORE)) - 1.1 * ("\n" in text[i:j])
        nodes.append(Node(i, j, j, score if opened is None else min(score, -3.0), opened, score, script(own.group())))
    return nodes


def _block_ends(text: str, a: int, b: int, lexicon: Lexicon) -> list[int]:
    nodes = _nodes(text, a, b, lexicon)
    if _SPACELESS.search(text, a, b):
        own = {n.end for n in nodes}
        nodes = sorted([*nodes, *(g for g in _gaps(text, a, b, lexicon) if g.end not in own)], key=lambda n: n.end)
    if not nodes:
        return []
    start = _BLANK.match(text, a, b).end()

    def short(u: int, v: int) -> float:
        """A sentence without any letter or number is unlikely."""
        return 0.0 if _ANY.search(text, u, v) else -2.5

    return best_ends(nodes, (start, _BARE.match(text, start, b).end()), b, short, lexicon)


def split(text: str | None, lexicon: Lexicon = Lexicon()) -> list[tuple[int, int]]:  # noqa: B008
    """(start, end) of each sentence. Null and blank texts have none."""
    if not text:
        return []
    out = []
    for a, b in _blocks(text):
        ends = _block_ends(text, a, b, lexicon)
        for end in (*ends, b):
            while a < end and text[a].isspace():
                a += 1
            e = end
            while e > a and text[e - 1].isspace():
                e -= 1
            if e > a:
                out.append((a, e))
            a = end
    return out


def _run(lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = lexicon()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                found = [split(t, own) for t in part.column(1).to_pylist()]
                counts = np.fromiter(map(len, found), np.int64, len(found))
                spans = np.array([s for f in found for s in f], np.int32).reshape(-1, 2)
                ids = pa.array(np.repeat(np.arange(len(found)), counts))
                yield pa.RecordBatch.from_arrays([part.column(0).take(ids), pa.array(spans[:, 0]), pa.array(spans[:, 1])], names=["doc_id", "start_char", "end_char"])

    return run


def sentences(df: DataFrame, id: str = "doc_id", text: str = "text", lexicon: Lexicon | None = None) -> DataFrame:
    """(doc_id, start_char, end_char): the sentences of each text; offsets count code points from 0, the end is exclusive.

    Spaced scripts go through a lattice of terminators, spaceless ones through one of blanks, classified by the words around
    them; their dictionary is counted over all texts unless it is given (see :func:`lexloom.llm.lattice.learn`). Texts are
    split one by one, without a shuffle; each is read whole. Null and blank texts give no rows, repeated rows give their
    sentences again, other columns are ignored.
    """
    rows = df.selectExpr(f"cast(`{id}` as bigint) as id", f"`{text}` as text").where("text is not null")
    known = by_value(df.sparkSession, learn(df, text) if lexicon is None else lexicon)
    return rows.mapInArrow(_run(known), "doc_id bigint, start_char int, end_char int")
