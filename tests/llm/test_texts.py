import random

import numpy as np
import pytest

from lexloom.llm import abuse, encoding, mixture, sentences

DEV = "case_id bigint, prefix string, source string, token string, n int, restored string, score string"


def dev(spark, rows):
    return spark.createDataFrame([(i, t, " News ", "x", 1, "y", "z") for i, t in rows], DEV)


# --- encodings ---------------------------------------------------------------------------------

CLEAN = ["Après le dîner il préfère le café près de l’école", "Mañana pidió la habitación según el niño", "Während der Übung prüft er die Tür für €50", "They don’t “like” the naïve idea — it costs £20…"]


@pytest.fixture(scope="module")
def garbled_rows():
    rng = random.Random(1)
    rows, truth = [], {}
    for i in range(400):
        t = CLEAN[i % 4].replace("50", str(rng.randrange(10, 99)))
        rows.append((i, f"{t} {rng.choice(['alpha', 'beta', 'gamma'])} {i}"))
    k = 1000
    for w, r in (("utf-8", "cp1252"), ("cp1252", "mac_roman"), ("utf-8", "mac_roman"), ("cp1252", "cp437")):
        for i in range(0, 40):
            t = rows[i][1]
            g = t.encode(w, "ignore").decode(r, "replace")
            rows.append((k, g))
            truth[k] = t
            k += 1
    return rows, truth


def test_garbled_found_and_restored(spark, garbled_rows):
    rows, truth = garbled_rows
    extra = [(5000, None), (5001, ""), (5002, "plain ascii &eacute;"), (5003, "broken � mark"), (5004, "SÃO PAULO É BELA"), (5005, "ÂGE")]
    found = {r.case_id for r in encoding.garbled(dev(spark, rows + extra)).collect()}
    assert 5003 in found and not found & {5000, 5001, 5002, 5004, 5005}
    assert not [i for i in found if i < 1000]
    assert len(found & set(truth)) >= 0.98 * len(truth)
    fixed = {r.case_id: r.restored for r in encoding.restored(dev(spark, rows + extra)).collect()}
    whole = [i for i in found & set(truth) if "�" not in dict(rows)[i]]
    assert sum(fixed[i] == truth[i] for i in whole) >= 0.9 * len(whole)


def test_garbled_blanks(spark):
    """Blanks at which tokens are cut are restored like other characters."""
    blanks = "\u3000\u2002\u2003\u2009\u202f"
    truth = {i: f"{c}an indent and {c} more words" for i, c in enumerate(blanks)}
    rows = [(i, t.encode().decode("cp1252")) for i, t in truth.items()]
    clean = [(100 + i, t) for i, t in truth.items()]
    assert {r.case_id for r in encoding.garbled(dev(spark, rows + clean)).collect()} == set(truth)
    assert {r.case_id: r.restored for r in encoding.restored(dev(spark, rows + clean)).collect()} == truth


def test_usual_words_stay(spark, garbled_rows):
    """Words that have the usual run of their slot are right, whatever frame or word a transformation makes of them."""
    rows, _ = garbled_rows
    clean = [(6000 + i, t) for i in range(10) for t in ("el jardín del país", "cállate ya", "Ö är en bokstav och Ö är en ö")]
    clean = [(6000 + k, t) for k, (_, t) in enumerate(clean)] + [(6500, "un delfín feliz"), (6501, "pálido y frío")]
    found = {r.case_id for r in encoding.garbled(dev(spark, rows + clean)).collect()}
    assert not found & {i for i, _ in clean}


def test_tokens_are_restored_one_by_one(spark, garbled_rows):
    """A garbled token that is a part of a clean word leaves that word alone."""
    rows, _ = garbled_rows
    dashes = [(7000 + i, f"one — two {i}") for i in range(40)] + [(7100 + i, f"one ó two {i}") for i in range(6)]
    both = [(7200, "the canal ó it was old and the habitación was small")]
    got = {r.case_id: r.restored for r in encoding.restored(dev(spark, rows + dashes + both)).collect()}
    assert got[7200] == "the canal — it was old and the habitación was small"
    kinds = {r.kind: r.cases for r in encoding.evidence(dev(spark, rows + dashes + both + [(7300, "\ufffd")])).collect()}
    assert kinds["twin"] > 100 and kinds["mark"] >= 1 and set(kinds) <= {"twin", "learned", "scripts", "mark", "prior"}


def test_no_garbled_rows(spark):
    assert encoding.garbled(dev(spark, [(1, "a"), (2, None)])).count() == 0
    assert encoding.restored(dev(spark, [(1, "a")]).limit(0)).count() == 0


@pytest.mark.parametrize("query", [encoding.garbled, encoding.restored, encoding.evidence])
def test_garbled_broadcasts_nothing(spark, garbled_rows, query):
    """No table that grows with the vocabulary is sent to the driver, however small its compressed file: frames in 16
    copies were."""
    context = spark._jsparkSession.sparkContext()
    store = spark._jsparkSession.sharedState().statusStore()

    def plans():
        context.listenerBus().waitUntilEmpty(30_000)
        runs = store.executionsList()
        return {(e := runs.apply(i)).executionId(): e.physicalPlanDescription() for i in range(runs.size())}

    before = plans()
    query(dev(spark, garbled_rows[0])).collect()
    new = [text for k, text in plans().items() if k not in before]
    assert sum("SortMergeJoin" in text for text in new) >= 4
    assert not [text for text in new if "Broadcast" in text]


# --- abuse ---------------------------------------------------------------------------------------


def test_tokens_undo_spellings():
    assert abuse.tokens("you L.O.S.E.R, stuuupid h3ll w***e @me #tag 12") == ["you", "loser", "stupid", "hel", "w*e5", "<user>", "<tag>", "<number>"]


def test_classifier_on_held_out_labels(spark):
    rng = random.Random(2)
    bad = ["you are a worthless idiot {}", "shut your stupid mouth {}", "{} you filthy liar crawl back", "go to hell {}"]
    good = ["{} painted the old bridge", "the museum of {} opened today", "{} feels worthless today please call", "the filthy river near {} was cleaned"]
    rows, y = [], []
    for i in range(1200):
        kind = rng.random() < 0.4
        t = rng.choice(bad if kind else good).format("".join(rng.choice("abcdefgh") for _ in range(7)))
        rows.append((i, t.replace("i", "ii") if rng.random() < 0.1 else t))
        y.append(int(kind))
    labels = [(i, 1 - y[i] if rng.random() < 0.05 else y[i], "a") for i in range(600)] + [(3, y[3], "b"), (None, 1, "c"), (7, None, "d"), (9999, 1, "e")]
    lab = spark.createDataFrame(labels, "case_id bigint, toxic int, annotator string")
    cases = dev(spark, rows + [(5000, None), (5001, ""), (5002, "fine words " * 3000)])
    got = {r.case_id: r for r in abuse.scores(cases, lab).collect()}
    assert len(got) == 1203 and not got[5000].abusive and not got[5001].abusive
    wrong = sum(got[i].abusive != bool(y[i]) for i in range(600, 1200))
    assert wrong <= 12
    r = abuse.rates(cases, lab).collect()
    assert len(r) == 1 and r[0].source == "news" and r[0].cases == 1203


def test_no_labels(spark):
    lab = spark.createDataFrame([], "case_id bigint, toxic int")
    assert abuse.abusive(dev(spark, [(1, "you idiot")]), lab).count() == 0


def test_gradient():
    """The numbers that training descends on are the slopes of the loss."""
    rng = np.random.default_rng(0)
    m = abuse._fresh(rng, np.ones(abuse.WORDS, bool))
    w, f = rng.integers(2, 50, (4, 9)).astype(np.int32), rng.integers(1, 50, (4, 9)).astype(np.int32)
    y = np.array([0, 1, 1, 0], np.float32)
    loss = lambda: -float(np.mean(y * np.log(p := m.forward(w, f)) + (1 - y) * np.log(1 - p)))
    p, h = m.forward(w, f), m.pooled(w, f)[0]
    slope = h.T @ ((p - y) / 4)
    i = int(np.abs(slope).argmax())
    before = loss()
    m.out[i] += 1e-2
    assert abs((loss() - before) / 1e-2 - slope[i]) < 2e-2


# --- mixture -------------------------------------------------------------------------------------


def test_mixture(spark):
    rng = random.Random(4)
    docs = [(i, " ".join("word" for _ in range(rng.randrange(1, 60))), src, 1) for i in range(900) for src in ["big" if i < 600 else "mid" if i < 880 else "tiny"]]
    docs += [(2000, None, "big", 1), (2001, "text", None, 1), (2002, "text", "other", 1), (2003, "", "big", 1), (None, "text", "big", 1)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, source string, grp int")
    t = spark.createDataFrame([("big", 0.5, 1), (" Mid", 0.3, 2), ("tiny", 0.15, 3), ("absent", 0.05, 2)], "source string, target_share double, max_repeats int")
    drawn = mixture.draw(d, t, total=12_000).collect()
    by = {}
    for r in drawn:
        by.setdefault(r.source, []).append(r)
    assert set(by) == {"big", "mid", "tiny"}
    size = {k: sum(r.tokens * r.uses for r in v) for k, v in by.items()}
    have = {k: sum(r.tokens for r in v) for k, v in by.items()}
    assert abs(size["big"] - 6000) <= 60 and abs(size["mid"] - 3600) <= 60
    assert size["tiny"] == min(1800, 3 * have["tiny"]) or abs(size["tiny"] - 1800) <= 60
    assert max(r.uses for r in by["big"]) == 1 and max(r.uses for r in by["tiny"]) <= 3
    assert max(r.uses for r in by["tiny"]) - min(r.uses for r in by["tiny"]) <= 1 or len(by["tiny"]) < 20
    again = mixture.draw(d.repartition(5), t, total=12_000).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, drawn))
    s = {r.source: r for r in mixture.shares(d, t, total=12_000).collect()}
    assert s["absent"].tokens == 0 and abs(sum(r.actual_share for r in s.values()) - 1) < 1e-4
    assert mixture.draw(d.limit(0), t).count() == 0 and mixture.draw(d, t.limit(0)).count() == 0


def test_weights_matter(spark):
    """Documents of better quality come earlier."""
    docs = [(i, ("good words here " if i % 2 else "## 12 ;; 44 ,, x ") * 6, "s") for i in range(800)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, source string")
    t = spark.createDataFrame([("s", 1.0, 1)], "source string, target_share double, max_repeats int")
    drawn = mixture.draw(d, t, total=4000).collect()
    good = sum(r.doc_id % 2 for r in drawn)
    assert good > 2 * (len(drawn) - good)


# --- sentences -----------------------------------------------------------------------------------

SPLIT = [
    ["Dr. Ulvax paid $3,669.99 at 5 p.m. in St. Orl.", "It rained .5 mm; no more."],
    ["Open a.txt or mail b@c.example if it fails.", "We saw i.e. Ann and the lock, etc., the mill of Orl."],
    ["X works for K Corp.", "Officials left.", "“Is it ready?” asked Ann.", '"Stop!" Bob shouted from the tram.'],
    ["Ann said: “We left. Nobody saw it.”", "The canal ... it was old and Bob knew it.", "What a mill! 😀", "Why?", "(See p. 7, ch. 2, by Ann.)", "Bob (who else?) left."],
    ["The show Nel! airs from Orl.", "'Ann knew,' said Bob, 'that it was odd!'", "“The mill was sold by Ann before noon.”", "Officials in Orl said so?!"],
    ["Am 14. Januar kam Dr. Wa, z. B. um 8.30 Uhr.", "„Gestern kam er?“, fragte Ann.", "Es kostet 5,50 Euro usw.", "Nächste Woche kommt er!"],
    ["« Hier il vint ! » dit Ann.", "M. Fa et Mme Wa : hier il vint, p. ex. à 8.30 h.", "À midi il partit…", "Très tôt il vint ?"],
    ["—¿Ayer vino Ann? —preguntó Bob.", "El Sr. Mo y la Dra. Ka pagaron 8.295,50 en la Av. Sol.", "¡Mañana vendrá!"],
    ["‘Gisteren kwam hij?’ vroeg Ann.", "Dhr. En en mevr. Ze wonen op nr. 57, bijv. in Ja a.d. Rijn.", "’s ochtends kwam hij."],
    ["«Вчера он пришёл?» — спросил Иван.", "В 1965 г. летом он купил дом, т. е. за 9,1 тыс. руб. и 20 коп.", "Летом он ушёл!"],
]


@pytest.mark.parametrize("parts", SPLIT)
def test_spaced_scripts(parts):
    text = " ".join(parts)
    assert [text[a:b] for a, b in sentences.split(text)] == parts


def test_spaceless_scripts():
    zh = ["昨天他来了。", "他问：“晚上她来吗？”", "“今天他走了。”她说。", "晚上他走了……", "早上他来了！"]
    assert [("".join(zh))[a:b] for a, b in sentences.split("".join(zh))] == zh
    ja = ["「朝彼は来た。」と彼女は言った。", "昨日彼は4.4キロ歩いた！", "夜彼は寝た？"]
    assert [("".join(ja))[a:b] for a, b in sentences.split("".join(ja))] == ja
    th = ["เมื่อวานโมเดชูซื้อสวนใหญ่ราคา 45.50 บาท", "ดร. โมเดชูโม ตอนเช้าเดปามาเควาดสวนใหญ่กับนาลารีบี", "วันนี้ซาซาดีนีซ่อมจดหมายใกล้เซฮาเบนี"]
    text = " ".join(th)
    assert [text[a:b] for a, b in sentences.split(text)] == th
    hi = ["डॉ. मो ने 8.5 किलो मापा।", "“वे शाम को आए?” जो ने पूछा।", "वे गए!"]
    assert [" ".join(hi)[a:b] for a, b in sentences.split(" ".join(hi))] == hi
    ko = ["“그는 어제 왔다.”라고 리 씨가 말했다.", "길이는 6.0미터이고 그는 갔다."]
    assert [" ".join(ko)[a:b] for a, b in sentences.split(" ".join(ko))] == ko


def test_layout():
    text = "A short heading\n\n- first item from here\n* second item\n1. third item\nUSER: did it work\nB: It did.\n\n  Last one here.  "
    assert [text[a:b] for a, b in sentences.split(text)] == ["A short heading", "- first item from here", "* second item", "1. third item", "USER: did it work", "B: It did.", "Last one here."]
    import textwrap

    prose = "The old museum near the river was cleaned by two officials late at night because the council had sold the other one before noon. Nobody in the town of Orl saw the long report that Ann wrote about the harbor and the mill last week."
    wrapped = textwrap.fill(prose, 70)
    assert [wrapped[a:b].replace("\n", " ") for a, b in sentences.split(wrapped)] == prose.replace("noon. ", "noon.\0").split("\0")


ABBREVIATED = [
    ["The answer was no.", "She left.", "It was no.", "Ann left, see no. 5 and No. IV there."],
    ["Sie ist meine Frau.", "Er kam mit Fr. Müller."],
    ["He works at Acme Inc.", "They hired him.", "Acme Inc. Berlin and Acme Co. of Orl paid."],
    ["We chose plan B.", "Then it rained.", "J. R. Smith and J. La Fontaine met Mr. I. A. Wa."],
    ["She lived in the U.S.", "He didn't, i.e. The Hague it was."],
    ["Er kam, z. B. Sie wissen es, um 8 Uhr.", "Er ging."],
    ["Он ел рис.", "Она ушла в 1965 г.", "Потом она вернулась, см. рис. 5 и др. Иванов."],
]


PROSE = ["The old museum near the river was cleaned by two officials late at night because the council had sold the other one before noon.", "Nobody in the town of Orl saw the long report that Ann wrote about the harbor and the mill last week.", "It was lost."]
PROSE_ZH = ["昨天他在城里的旧博物馆里看见了两位官员和一座很长的木桥因为市政府在中午之前已经把另外一座卖掉了。", "没有人在镇上读过安娜上个星期写的关于港口和磨坊的那份很长的报告。", "晚上他走了。"]


@pytest.mark.parametrize("width", [40, 70, 120])
@pytest.mark.parametrize("extra", ["", "ประตู ", "門 "])
def test_wrapped_prose(width, extra):
    import textwrap

    parts = [extra + PROSE[0], *PROSE[1:], *PROSE]
    wrapped = textwrap.fill(" ".join(parts), width)
    assert [wrapped[a:b].replace("\n", " ") for a, b in sentences.split(wrapped)] == parts


def test_wrapped_prose_with_a_longer_line():
    import textwrap

    lines = textwrap.wrap(" ".join(PROSE * 3), 60)
    lines[4] += " " + lines.pop(5)[:30].rsplit(" ", 1)[0]
    wrapped = "\n".join(lines)
    got = [wrapped[a:b].replace("\n", " ") for a, b in sentences.split(wrapped)]
    assert len(got) == 9 and got[:2] == PROSE[:2] and got[-3:] == PROSE


def test_wrapped_ideographs_and_thai():
    text = "".join(PROSE_ZH * 2)
    wrapped = "\n".join(text[i : i + 20] for i in range(0, len(text), 20))
    assert [wrapped[a:b].replace("\n", "") for a, b in sentences.split(wrapped)] == PROSE_ZH * 2
    th = "เมื่อวานโมเดชูซื้อสวนใหญ่กับเพื่อนใกล้ตลาดเก่าโดยไม่มีโคมไฟใหม่ที่สะพานใหญ่ใกล้ประตูสีเขียว" * 3
    wrapped = "\n".join(th[i : i + 44] for i in range(0, len(th), 44))
    assert len(sentences.split(wrapped)) == 1


@pytest.mark.parametrize("text", ["roses are red\nviolets are blue\nsugar is sweet\nand so are you", "床前明月光，\n疑是地上霜。\n举头望明月，\n低头思故乡。", "buy milk\ncall the bank\nwrite to Ann about the mill\nsleep", "ประตูสีเขียว\nสวนใหญ่\nจดหมายเก่าที่ตลาด"])
def test_short_lines_stay(text):
    assert [text[a:b] for a, b in sentences.split(text)] == text.split("\n")


NATURAL = [
    ["ผมไปโรงเรียน", "ฝนตกหนักมาก", "เด็กๆวิ่งเล่น"],
    ["ข้าวเปียกฝนหมดแล้วครับ", "แต่พรุ่งนี้แดดจะออก", "คุณ สมชายจะมาช่วย"],
    ["ຂ້ອຍໄປໂຮງຮຽນ", "ລາວບໍ່ມາເຮັດວຽກ", "ແຕ່ມື້ນີ້ຝົນຕົກ"],
    ["ខ្ញុំទៅសាលារៀន", "ថ្ងៃនេះភ្លៀងខ្លាំងណាស់"],
    ["今天下雨了", "我们没有去学校", "明天再说吧"],
    ["昨日は雨でした", "私は家にいました"],
    ["He said no.", "Then he left the room.", "She takes vitamin C.", "It helps a lot.", "We chose plan B.", "Bob left."],
    ["Mrs. Dalloway said she would buy the flowers herself.", "For Lucy had her work cut out for her."],
    ["It was the best of times, it was the worst of times.", "“Are you there, Mr. Holmes?” he cried.", "Nobody (not even J. K. Jerome) knew.", "See ch. 4, fig. 2.", "The U.S. Senate met at 9 a.m. on Monday.", "It adjourned at 5 p.m."],
    ["Prof. Dr. Meier kam um 8.15 Uhr.", "„Guten Tag!“, sagte er.", "Das war am 3. Oktober in St. Gallen."],
    ["La casa de la Sra. Pérez es roja.", "¿Quién vive allí?", "Nadie."],
]


@pytest.mark.parametrize("parts", NATURAL)
def test_sentences_of_common_texts(parts):
    """Nothing is learned here: general words of the scripts must do."""
    text = " ".join(parts)
    assert [text[a:b] for a, b in sentences.split(text)] == parts


def test_dictionary_is_learned(spark):
    """Openers, titles and particles of an invented spaceless language come from the lines of the corpus."""
    rng = random.Random(11)
    letters = [chr(c) for c in range(0x1000, 0x1020)]
    make = lambda n: "".join(rng.choice(letters) for _ in range(n))
    openers, nouns, verbs, title, unit = [make(4) for _ in range(6)], [make(5) for _ in range(30)], [make(3) for _ in range(8)], make(2), make(3)
    name = lambda: make(rng.randrange(4, 7))

    def sentence():
        end = f" {rng.randrange(10, 99)} {unit}" if rng.random() < 0.3 else ""
        return (f"{title} {name()} " if rng.random() < 0.3 else "") + rng.choice(openers) + name() + rng.choice(verbs) + rng.choice(nouns) + name() + end

    docs, truth = [], {}
    for i in range(1500):
        lines = [[sentence() for _ in range(rng.choice([1, 1, 2, 3, 5]))] for _ in range(2)]
        docs.append((i, "\n".join(" ".join(x) for x in lines)))
        truth[i] = [s for x in lines for s in x]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    texts = dict(docs)
    got: dict[int, list[str]] = {}
    for r in sorted(sentences.sentences(df).collect()):
        got.setdefault(r.doc_id, []).append(texts[r.doc_id][r.start_char : r.end_char])
    both = sum(len(set(got[i]) & set(truth[i])) for i in truth)
    assert both >= 0.97 * sum(map(len, truth.values())) and both >= 0.97 * sum(map(len, got.values()))
    plain = sum(len({t[a:b] for a, b in sentences.split(t)} & set(truth[i])) for i, t in docs)
    assert plain < 0.9 * both  # which the general words alone do not give


@pytest.mark.parametrize("make", [lambda n: "(" * n + "”" * n, lambda n: "Am 12. Mai " * n, lambda n: "“a.” " * n, lambda n: "“a.”" * n, lambda n: "x. " * n, lambda n: "ก " * n, lambda n: "他。" * n, lambda n: "No! " * n + "a" * n, lambda n: "'" * n + "a " * n, lambda n: "(a. “b.” " * n])
def test_time_grows_with_length(make):
    """One long line costs no more a character than a short one."""
    import time

    def seconds(n):
        text, best = make(n), 9e9
        for _ in range(2):
            began = time.perf_counter()
            sentences.split(text)
            best = min(best, time.perf_counter() - began)
        return best

    assert seconds(16_000) < 4 * 4 * max(seconds(4000), 0.01)


@pytest.mark.parametrize("parts", ABBREVIATED)
def test_abbreviations_may_end(parts):
    text = " ".join(parts)
    assert [text[a:b] for a, b in sentences.split(text)] == parts


@pytest.mark.parametrize("blanks", [1, 60, 200, 500])
def test_wide_gaps(blanks):
    """Padding between sentences hides no end."""
    parts = ["Ann sold the mill.", "“Is it ready?”", "Bob left the town.", "(See the long report.)", "“We left.” Ann said so.", "It rained!", "“No.” she said."]
    text = (" " * blanks).join(parts)
    assert [text[a:b] for a, b in sentences.split(text)] == parts
    text = f"“Is it ready?”{' ' * blanks}asked Ann.{' ' * blanks}Bob left."
    assert len(sentences.split(text)) == 2


def test_every_character_once_and_edges(spark):
    rng = random.Random(9)
    alphabet = "ab C.!?…。\"'“”‘’«»()\n \t　ก中:—-1.,😀"
    for _ in range(400):
        t = "".join(rng.choice(alphabet) for _ in range(rng.randrange(80)))
        spans = sentences.split(t)
        covered = "".join(t[a:b] for a, b in spans)
        assert all(a < b and not t[a].isspace() and not t[b - 1].isspace() for a, b in spans)
        assert all(x[1] <= y[0] for x, y in zip(spans, spans[1:], strict=False))
        assert [c for c in covered if not c.isspace()] == [c for c in t if not c.isspace()]
    d = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "One. Two.", 0), (3, "One. Two.", 0), (4, "word " * 60000, 0)], "doc_id bigint, text string, start_char int")
    got = sorted(map(tuple, sentences.sentences(d).collect()))
    assert got == [(3, 0, 4), (3, 0, 4), (3, 5, 9), (3, 5, 9), (4, 0, 299999)]
    assert sentences.sentences(d.limit(0)).count() == 0
