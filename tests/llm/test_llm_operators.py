"""The training-data operators on small cases and against brute force."""

import random
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import abuse, bpe, canon, cuts, leaks, pii, runs, scans

LONG = "记录封存 " * 60_000


# ---- p1 ----

PII = [
    ("把名单寄jorah_5953979@mail.example.net，别发评论区", {"email"}),
    ("有资料发我ｔａｍｓｉｎ．ｕ８３０＠ｍａｉｌ．ｅｘａｍｐｌｅ．ｎｅｔ", {"email"}),
    ("write to a.b7 (at) example dot com please", {"email"}),
    ("see you at example.com tomorrow", set()),
    ("打我手机 142-6056-8591", {"phone"}),
    ("加v同号一四二九五九七零四六五", {"phone"}),
    ("text me on (202) 555-0136", {"phone"}),
    ("call 07700 900280.", {"phone"}),
    ("播放量15006805013次了还没人管", set()),
    ("快递单535-0846还没到，打12999问过了", set()),
    ("order 995757738 never arrived, rated 807-40 in the poll", set()),
    ("订单号962328200713455234卡了三天", set()),
    ("证件号：997825198305098882 求帮查", {"id_number"}),
    ("sfz 963263 19730903 4183", {"id_number"}),
    ("我的护照号G82426785，请核实", {"id_number"}),
    ("id no. 922-17-7568 on the form", {"id_number"}),
    ("地址新渚区松针弄650号2栋475室", {"street_address"}),
    ("I live at 764 Saltmarsh Avenue, Apt 55.", {"street_address"}),
    ("住在听雨街附近的人都听说了。Old Mill Street is closed", set()),
    ("我叫闻澍舟。", {"person_name"}),
    ("司徒砚野本人也在看，实名举报骆岫", {"person_name"}),
    ("樊老师讲得比岳律师细，@纸飞机0423", set()),
    ("regards, Odalys Thackmoor, ask for Old Mill Street", {"person_name"}),
    ("Margaret Thornton phoned me yesterday", {"person_name"}),
    ("联系王小明吧", {"person_name"}),
    ("联系方式见主页，高速路口在修", set()),
    ("My name is José García", {"person_name"}),
    ("reach John Smith on Monday", {"person_name"}),
    ("her passport is X1234567", {"id_number"}),
    ("见 11010519491231002X，另一个 110105194912310021 不对", {"id_number"}),
    ("编号里的 110105194912310021", set()),
    ("12 rue de Rivoli, Paris", {"street_address"}),
    ("er wohnt Hauptstraße 5", {"street_address"}),
    ("New York who called, The Old Mill Road is closed", set()),
    ("", set()),
    (None, set()),
]


@pytest.mark.parametrize("text,kinds", PII)
def test_pii_kinds(text, kinds):
    assert {k for _, _, k in pii.find(text)} == kinds


def test_redaction_keeps_all_else():
    t = "开头 打我手机​１４２-6056-8591，写信到 a1@b.cc 就行 结尾"
    assert pii.redact(t) == "开头 打我手机​[PHONE]，写信到 [EMAIL] 就行 结尾"
    spans = pii.find(t)
    kept = "".join(c for i, c in enumerate(t) if not any(a <= i < b for a, b, _ in spans))
    assert kept == pii.redact(t).replace("[PHONE]", "").replace("[EMAIL]", "")
    assert pii.redact(None) is None and pii.redact(LONG) == LONG


def test_long_parts_leave_nothing_behind():
    local, host = "a." * 90 + "b", ".".join(["host"] * 60) + ".example.com"
    assert pii.redact(f"写信 {local}@{host} 即可") == "写信 [EMAIL] 即可"
    assert pii.redact("电话" + " " * 60 + "5551234") == "电话" + " " * 60 + "[PHONE]"


def test_pii_table(spark):
    rows = [("comments", "1", "电话15408636415", "x"), ("comments", "1", "电话15408636415", "y"), ("comments", None, "电话15408636415", "z"), ("comments", "2", None, "z"), ("comments", "3", LONG, "z")]
    df = spark.createDataFrame(rows, "record_table string, record_id string, text string, pii_kind string")
    assert [tuple(r) for r in pii.find_pii(df).collect()] == [("comments", "1", "phone")]
    assert pii.find_pii(df.limit(0)).count() == 0
    more = df.unionByName(spark.createDataFrame([("comments", None, "写信到 a1@b.cc", "z"), ("comments", "2", "第二段", "z")], df.schema))
    assert sorted((r.record_id or "-", r.text or "-") for r in pii.redact_texts(more).collect()) == [("-", "写信到 [EMAIL]"), ("-", "电话[PHONE]"), ("1", "电话[PHONE]"), ("2", "-"), ("2", "第二段"), ("3", LONG)]


# ---- p2 ----

SCAN = "Working Paper Series\nThe clip drew replies and the off-\nice closed at noon.\n- 3 -\fWorking Paper Serias\nA night-\nshift driver paused here.\n- 4 -\n"


def test_scan_kinds_and_repair():
    decided = {"w:night-shift": "=", "w:nurnber": "w:number", "t:有入点": "t:有人点"}
    assert scans.noise_kinds(SCAN, decided) == {"running_header", "page_number", "hyphen_break"}
    assert scans.repair(SCAN, decided) == "The clip drew replies and the office closed at noon.\n\nA night-shift driver paused here." or scans.repair(SCAN, decided) == "The clip drew replies and the office closed at noon. A night-shift driver paused here."
    assert scans.noise_kinds("有入点头称是，\n还有别的。", decided) == {"misread"}
    assert scans.repair("有入点头称是，\n还有别的。", decided) == "有人点头称是，还有别的。"
    for plain in (None, "", "  ", "nan", "B2B\n5G 试点\n2024\n正文在此。", "one line\nwraps here."):
        assert scans.noise_kinds(plain, decided) == set()
    assert scans.noise_kinds("a re\xad\nhabilitation", {}) == {"hyphen_break"}


def test_scan_table_both_ways(spark):
    clean = "the number of people asked about it, and the office closed at noon again"
    rows = [(i, f"{clean} number {i}", None, None, None, "x") for i in range(30)] + [(100, "the nurnber of people asked", "the of-\nfice closed", None, None, "x"), (100, "the nurnber of people asked", "the of-\nfice closed", None, None, "y"), (None, SCAN, None, None, None, "z"), (101, None, " ", None, None, "z")]
    df = spark.createDataFrame(rows, "text_record_id long, ocr_text string, subtitle_text string, transcript_text string, title_text string, noise_kind string")
    want = {(100, "ocr_text", "misread"), (100, "subtitle_text", "hyphen_break")}
    assert {tuple(r) for r in scans.find_noise(df).collect()} == want
    assert {tuple(r) for r in scans.find_noise(df, most=0).collect()} == want
    assert {r.text for r in scans.repair_texts(df, most=0).filter("text_record_id = 100").collect()} == {"the number of people asked", "the office closed"}
    assert scans.find_noise(df.limit(0)).count() == 0


@pytest.mark.parametrize("header", ["Report (No. 5) Annex", "通报（第二，三号）附件"])
def test_header_with_a_mark_inside_brackets(header):
    assert scans.noise_kinds(f"{header}\nThe clip drew replies.\n\f{header}\nIt closed at noon.\n", {}) == {"running_header"}


class _Asked(dict):
    """Decides nothing and notes what it is asked."""

    def __init__(self):
        self.keys_asked = set()

    def get(self, key, default=None):
        self.keys_asked.add(key)
        return default

    def __contains__(self, key):
        self.keys_asked.add(key)
        return False


@pytest.mark.parametrize("text", ["the nurn-\nber of a nurnber-based list", "前文。\n\n入点头。\n入口abc\n入点", "a long-\nterrn plan\n\nclirnb-down", SCAN])
def test_tokens_hold_all_that_is_looked_up(text):
    asked = _Asked()
    scans.noise_kinds(text, asked)
    scans.repair(text, asked)
    own = scans.tokens(text)
    # words without another reading and signs nobody confuses are never put right
    assert {k for k in asked.keys_asked if (k[3] in scans._HAN if k[0] == "t" else scans.alternatives(k[2:]))} <= own


def test_misread_inside_a_broken_word_both_ways(spark):
    clean = "the number of people asked about it, and the office closed at noon again"
    rows = [(i, f"{clean} number {i}", None, None, None) for i in range(30)] + [(100, "the nurnber of people asked", None, None, None), (101, "the nurn-\nber of people asked", "a nurnber-based list", None, None)]
    df = spark.createDataFrame(rows, "text_record_id long, ocr_text string, subtitle_text string, transcript_text string, title_text string")
    for most in (scans.MOST_SENT, 0):
        assert {(r.field, r.noise_kind) for r in scans.find_noise(df, most=most).filter("text_record_id = 101").collect()} >= {("ocr_text", "misread"), ("ocr_text", "hyphen_break")}
        assert {r.text for r in scans.repair_texts(df, most=most).filter("text_record_id = 101").collect()} == {"the number of people asked", "a number-based list"}


# ---- p3 ----


def test_canonical_equals_whole_normalization():
    rng = random.Random(3)
    pool = [chr(c) for c in (*range(0x20, 0x7F), *range(0xC0, 0x180), *range(0x300, 0x310), *range(0x391, 0x3CA), *range(0x400, 0x460), 0x200B, 0xFEFF, 0xAD, 0xA0, 0x3000, 0x2009, *range(0xFF01, 0xFF5F), *range(0x2F00, 0x2F20), 0xF967, 0x1100, 0x1161, 0x11A8, 0xAC00, 0xFB01, 0x2460)]

    def whole(t):
        t = "".join(" " if unicodedata.category(c) == "Zs" else c for c in t if not canon._invisible(c))
        return unicodedata.normalize("NFC", unicodedata.normalize("NFKD", t).translate(canon._FOLD))

    for _ in range(3000):
        t = "".join(rng.choice(pool) for _ in range(rng.randrange(12)))
        once = canon.canonical(t)
        assert once == whole(t), [hex(ord(c)) for c in t]
        assert canon.canonical(once) == once


@pytest.mark.parametrize("a,b", [("ｃａｆé 截至１０５", "café 截至105"), ("Lаtе tο", "Late to"), ("a b", "a b"), ("⼀⼤", "一大"), ("设​定", "设定")])
def test_same_looks(a, b):
    assert canon.canonical(a) == canon.canonical(b)


@pytest.mark.parametrize("a,b", [("Abc", "abc"), ("cafe", "café"), ("a\nb", "a b"), ("0K", "OK"), ("好。", "好")])
def test_visible_differences_stay(a, b):
    assert canon.canonical(a) != canon.canonical(b)


def test_same_looks_pairs_match_brute_force(spark):
    rng = random.Random(5)
    texts = ["路过 看看", "路过　看看", "路过​ 看看", "ОK 了", "OK 了", "nan", "ｎａｎ", " ", None, ""]
    rows = [(i, rng.choice([1, 2, None]), rng.choice(texts), "x") for i in range(150)]
    rows += rows[:40] + [(None, 1, "OK 了", "x")]
    df = spark.createDataFrame(rows, "id long, video_id long, text string, form string")
    got = {tuple(r) for r in canon.same_looks(canon.look_keys(df, F.col("id"), F.col("video_id"), F.col("text"))).collect()}
    uniq = {(i, v, t) for i, v, t, _ in rows if i is not None and v is not None and t and canon.canonical(t).strip() and canon.canonical(t) != "nan"}
    want = {(min(i, j), max(i, j)) for i, v, t in uniq for j, u, s in uniq if i != j and v == u and t != s and canon.canonical(t) == canon.canonical(s)}
    assert got == want and want
    assert canon.same_looks(canon.look_keys(df.limit(0), F.col("id"), F.col("video_id"), F.col("text"))).count() == 0


# ---- p6 ----


def _runs(rows, bits=8, gap=1.0):
    """Plain loop over one video's latest run."""
    out, cur = [], []
    for r in rows:
        ok = cur and cur[-1][3] is not None and r[3] is not None and (cur[-1][3] ^ r[3]).bit_count() <= bits and None not in (r[1], cur[-1][2]) and r[1] - cur[-1][2] <= gap + 1e-9
        if not ok:
            if len(cur) > 1:
                out.append((cur[0][0], cur[-1][0], len(cur)))
            cur = []
        cur.append(r)
    if len(cur) > 1:
        out.append((cur[0][0], cur[-1][0], len(cur)))
    return out


@pytest.mark.parametrize("block", [3, 7, 4096])
def test_runs_match_a_plain_loop(spark, block):
    rng = random.Random(block)
    rows, want = [], set()
    for v in range(12):
        t, h, seq = 0.0, rng.getrandbits(64), []
        for i in range(rng.randrange(1, 60)):
            if rng.random() < 0.15:
                continue
            h = rng.choice([h, h, h ^ (1 << rng.randrange(64)), rng.getrandbits(64)])
            s = round(t + rng.choice([0, 0, 1.0, 1.001, -0.2, 5]), 3)
            e = round(s + 2.5, 3)
            t = e
            seq.append((i, s, e, None if rng.random() < 0.05 else h))
        for r in seq:
            hx = None if r[3] is None else rng.choice([f"{r[3]:016x}", f"{r[3]:016X}", f"0x{r[3]:016x}", f" {r[3]:016x} "])
            vid = rng.choice([f"v{v}", f" v{v}", f"v{v}.0"])
            rows += [(vid, "run_2", r[0], r[1], r[2], hx, "x")] * rng.choice([1, 1, 2])
            rows.append((f"v{v}", "run_1", r[0], r[1], r[2], "0" * 16, "x"))
        want |= {(f"v{v}", a, z, n) for a, z, n in _runs(seq)}
    rng.shuffle(rows)
    rows += [(None, "run_2", 1, 0.0, 1.0, "0" * 16, "x"), ("v0", "run_2", None, 0.0, 1.0, "0" * 16, "x")]
    df = spark.createDataFrame(rows, "video_id string, run_name string, segment_index int, start_second double, end_second double, phash_hex string, block string")
    got = {(r.video_id, r.first_segment_index, r.last_segment_index, r.slice_count) for r in runs.collapse_runs(df, block=block).collect()}
    assert got == want
    assert runs.collapse_runs(df.limit(0)).count() == 0


# ---- p7 ----


def test_abuse_model_generalises_to_spellings():
    rng = random.Random(1)
    bad, good = ["蠢货", "垃圾玩意", "moron", "parasite"], ["高明", "清楚", "calm", "decent"]
    texts, labels = [], []
    for _ in range(400):
        y = rng.randrange(2)
        w = rng.choice(bad if y else good)
        texts.append(rng.choice(["认真的，楼上{}闭嘴吧！", "说真的，{}也配评论。", "you are a {} really!"]).format(w) + rng.choice(["", "，大家怎么看？", " 就这样。"]))
        labels.append(y)
    m = abuse.train(texts, labels, epochs=6)
    s = m.scores(["楼上蠢*货闭嘴吧", "you are a m*o*r*o*n really!", "you are a mooooron really", "说真的，清楚也配评论。", None, "", " !! ", LONG])
    assert min(s[:3]) > 0.5 > s[3] and list(s[4:7]) == [0, 0, 0]
    assert abuse.clauses("D3$3rv3 @ b3@t1ng!") == [" deserve a beating "]


def test_labels_resolve(spark):
    rows = [("comments", "1", "yes", "0", 1, "n"), ("comments", "2", "辱骂", "1.0", None, "n"), ("comments", "3", "no", "yes", None, None), ("comments", "4", None, "no", None, None), ("comments", None, "1", "1", 1, None), ("comments", "2", "辱骂", "1.0", None, "n")]
    df = spark.createDataFrame(rows, "record_table string, record_id string, label_annotator_a string, label_annotator_b string, adjudicated_label int, label string")
    assert {(r.record_id, r.label) for r in abuse.resolved_labels(df).collect()} == {("1", 1), ("2", 1)}


# ---- p8 ----


def test_bpe_equals_the_public_encoder(spark):
    import tiktoken

    ranks = bpe.load_ranks()
    enc = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(2)
    texts = ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0x4E00, 0x9FFF), rng.randrange(0x3040, 0x30FF), rng.randrange(0x1F300, 0x1F6FF), 0x200B, 0x3000, 10])) for _ in range(rng.randrange(1, 120))) for _ in range(200)]
    texts += ["a" * 3000, "哈" * 2000, " " * 900, "it's we'll DON'T\n\n  x", "<|endoftext|>", LONG]
    e = bpe.Encoder(ranks)
    ids = e.encode(texts)
    assert ids == [enc.encode_ordinary(t) for t in texts]
    assert all(b"".join(e.token[i] for i in x).decode() == t for x, t in zip(ids, texts))
    df = spark.createDataFrame([(1, "hi 你好", "z"), (1, "hi 你好", "z"), (2, "", "z"), (3, None, "z")], "doc_id long, text string, ids string")
    got = {r.doc_id: list(r.ids) for r in bpe.encode_corpus(df).collect()}
    assert got == {1: enc.encode_ordinary("hi 你好"), 2: [], 3: []}
    assert bpe.encode_corpus(df.limit(0)).count() == 0
    rows = [(1, "hi 你好"), (1, "hi 你好"), (1, "other"), (2, None), (2, ""), (None, "a"), (None, "b"), (3, "hi " * 40_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted({(i, tuple(enc.encode_ordinary(t or ""))) for i, t in rows}, key=repr)
    for most in (0, 100):
        assert sorted(((r.doc_id, tuple(r.ids)) for r in bpe.encode_corpus(df, most=most).collect()), key=repr) == want


# ---- p9 ----


def test_leaks(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(3, 9)))
    passage = lambda: " ".join(word() for _ in range(90))
    han = lambda: "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(170))
    shared = " ".join(word() for _ in range(12))
    items = [(1, passage() + " " + shared), (2, shared + " " + passage()), (3, han()), (4, None), (5, "")]
    filler = lambda: passage()
    t1, t3 = items[0][1], items[2][1]
    docs = [
        (10, filler() + ". " + t1.upper() + " " + filler()),
        (11, filler() + t3[:40] + "，" + filler() + t3[60:110]),
        (12, filler() + " " + " ".join(t1.split()[:12])),
        (13, filler() + " " + shared),
        (14, "".join(c + ("​" if i % 9 == 0 else "") for i, c in enumerate(t3))),
        (15, None),
        (16, ""),
        (10, filler() + ". " + t1.upper() + " " + filler()),
        (17, " ".join(w if i != 25 else "other" for i, w in enumerate(t1.split()[:50]))),
    ]
    d = spark.createDataFrame([(*x, "x") for x in docs], "doc_id long, text string, item_id string")
    i = spark.createDataFrame([(*x, "x") for x in items], "item_id long, passage string, text string")
    want = {(10, 1), (11, 3), (14, 3), (17, 1)}
    assert {(r.doc_id, r.item_id) for r in leaks.find_leaks(d, i).collect()} == want
    assert leaks.find_leaks(d.limit(0), i).count() == 0 and leaks.find_leaks(d, i.limit(0)).count() == 0


def _han(rng, n):
    return "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(n))


def _words(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(3, 9))) for _ in range(n))


def _index(texts):
    """An index without shared shingles."""
    return leaks.Index([(str(i), leaks.folded(t), {}) for i, t in enumerate(texts)])


def test_candidates_hold_every_pair_that_verifies():
    rng = random.Random(9)
    texts = [_han(rng, n) for n in (20, 33, 60, 170)] + [_words(rng, n) for n in (4, 12, 24, 90)]
    index = _index(texts)
    docs = []
    for step in (4, 8, 15, 24):
        docs += [_han(rng, 20) + "".join(c if i % (step + 2) < step else _han(rng, 1) for i, c in enumerate(t)) for t in texts[:4]]
        docs += [" ".join(w if i % step else _words(rng, 1) for i, w in enumerate(t.split())) for t in texts[4:]]
        docs += [t[step : step * 4] for t in texts]
    points = [leaks.folded(d) for d in docs]
    got = [{i for i, _ in h} for h in leaks.leaked(index, points)]
    ks = {x.kind[0] for x in index.items}
    sets = [{k: np.unique(leaks.shingle_hashes(p, k)) for k in ks} for p in points]
    assert got == [{x.key for at, x in enumerate(index.items) if index.share(at, s[x.kind[0]]) >= leaks.SHARE} for s in sets]
    assert all(str(i) in h for i, h in zip(range(8), got[48:56]))


def test_long_documents_are_read_piece_by_piece(monkeypatch):
    rng = random.Random(12)
    texts = [_han(rng, 60), _words(rng, 30)]
    index = _index(texts)
    docs = [leaks.folded(_han(rng, 700) + texts[0] + _han(rng, 300)), leaks.folded(texts[1] + _words(rng, 200))]
    whole = leaks.leaked(index, docs)
    assert [[i for i, _ in h] for h in whole] == [["0"], ["1"]]
    monkeypatch.setattr(leaks, "STEP_CHARS", 7)
    monkeypatch.setattr(leaks, "STEP_PAIRS", 3)
    assert leaks.leaked(index, docs) == whole


def test_leaks_whatever_the_parts(spark):
    rng = random.Random(5)
    a, b, c = _han(rng, 100), _han(rng, 100), _han(rng, 100)
    # 1 and 2 share half their wording, 3 and 4 are equal but for width and case, 5 is short
    items = [(1, a + b), (2, b + c), (3, "Ａ" + _words(random.Random(1), 40)), (4, "a" + _words(random.Random(1), 40).upper()), (5, "the quick brown fox jumps over the lazy dog now"), (6, _han(rng, 20)), (5, _words(rng, 50))]
    docs = [(1, b), (2, a + b), (3, "x " + items[2][1][1:]), (4, "He said the quick brown fox jumps over the lazy dog."), (5, _han(rng, 9) + items[5][1] + _han(rng, 30)), (6, items[6][1][:200]), (7, _han(rng, 300))]
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, passage string")
    one = {(r.doc_id, r.item_id, round(r.share, 9)) for r in leaks.find_leaks(d, i).collect()}
    many = {(r.doc_id, r.item_id, round(r.share, 9)) for r in leaks.find_leaks(d, i, part_chars=50).collect()}
    assert one == many
    assert {(x, y) for x, y, _ in one} == {(2, 1), (3, 3), (3, 4), (4, 5), (5, 6), (6, 5)}


def test_block_lookup_misses_none_within_the_radius():
    rng = np.random.default_rng(6)
    index = _index(["".join(chr(c) for c in rng.integers(0x4E00, 0x9000, 200))])
    known = index.tables[6][0]
    prints = []
    for k in range(400):
        p = int(known[k % len(known)])
        for b in rng.choice(64, rng.integers(0, 5), replace=False):
            p ^= 1 << int(b)
        prints.append(p)
    prints = np.array(prints, np.uint64)
    got = {i for w, _ in index.candidates(prints, 6) for i in w.tolist()}
    assert got == {i for i, p in enumerate(prints) if (np.bitwise_count(known ^ p) <= leaks.RADIUS).any()}


# ---- what is handed on keeps its script ----

SCRIPTS = [("Москва", "Москва", "Москва"), ("Мoсква", "Москва", "Москва"), ("pаypаl", "paypal", "paypal"), ("Привет, wоrld", "Привет, world", "Привет, world"), ("ΑΒΓ", "ΑΒΓ", "ΑΒΓ"), ("сор", "cop", "сор"), ("cop", "cop", "cop"), ("ёлка", "ёлка", "ёлка"), ("Ｃａｆｅ́", "Café", "Café")]


@pytest.mark.parametrize("text,form,read", SCRIPTS)
def test_words_stay_in_their_script(text, form, read):
    assert (canon.one_form(text), canon.readable(text)) == (form, read)
    assert canon.one_form(form) == form


def test_classes_hold_the_pairs(spark):
    rows = [(i, "v", "pay" if i % 3 else "pаy") for i in range(30)] + [(40, "v", "alone"), (41, "w", "pаy"), (42, None, "pay"), (43, "v", None)]
    keys = canon.look_keys(spark.createDataFrame(rows, "id long, v string, t string"), F.col("id"), F.col("v"), F.col("t"))
    got = {r.id: (r.class_id, r.n_forms) for r in canon.look_classes(keys).collect()}
    assert got == {i: (0, 2) for i in range(30)}
    assert canon.same_looks(keys).count() == 200


def test_scan_headers_stand_at_edges():
    page = "{}\nA line of the page that goes on for a while, and on,\nand then it stops.\n"
    text = "\f".join(page.format("Annual Report of the Municipal Commission for Records, Files and Appeals (No. 5) and Annex B to it".replace(",", "")) for _ in range(2))
    assert scans.Page(text).kind.count("header") == 2
    body = "First line of the page that runs along.\nIt goes on here.\n{}\nMore of the page is here now.\nStill more of it, and then an end.\n".format("Refrain of the old song")
    for text in (body + "\f" + body, body + body):
        assert "header" not in scans.Page(text).kind and "Refrain" in scans.repair(text, {})
    assert scans.Page("One line of text here.\n- - - - - - - - - - - - - 12 - - - - - - - - - - - -\nAnd more.").kind[1] == "number"
    assert scans.repair("Москва и ＡＢＣ", {}) == "Москва и ABC"


# ---- p10 ----

ENDS = [("整句结束。", "sentence"), ("它说：“好。”", "sentence"), ("前面一句。然后就在这里被", "open"), ("One sentence. And the cut wo", "open"), ("前面一句。后面…展开", "debris"), ("One. Two&nb", "debris"), ("一句。半个�", "debris"), ("一句。\\u5c", "debris"), ("一句。<b", "debris"), ("一句。#标签", "tag"), ("一句。 https://v.example.com/7f", "link"), ("一句。 👍", "emoji"), ("一句。\n——小满", "signature"), ("一句。\n赞 476", "counter"), ("一句。（完）", "closing"), ("A sentence. (end)", "closing"), ("没有标点的标题", "heading"), ("整句……", "dots"), ("One sentence...", "dots"), ("", "heading")]


def test_endings(spark):
    df = spark.createDataFrame([(t,) for t, _ in ENDS], "t string")
    assert [r[0] for r in df.select(cuts.ending(F.col("t"))).collect()] == [k for _, k in ENDS]


def test_cuts_at_a_limit(spark):
    rng = random.Random(8)
    rows = []
    for i in range(600):
        t = "".join(rng.choice("甲乙丙丁戊己庚辛") for _ in range(rng.randrange(20, 260))) + "。"
        rows.append((i, t[:200] if i % 2 else t, "limited" if i % 2 else "free", "x"))
    rows += [(1000, None, "limited", "x"), (1001, " ", None, "x"), (None, "一句。半", "free", "x"), (1002, "一句。半", None, "x"), (1002, "一句。半", None, "x"), (1003, LONG + "。", "free", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, ending string")
    got = {r.doc_id for r in cuts.find_cuts(df).collect()}
    assert got == {i for i, t, s, _ in rows if i is not None and i < 1000 and s == "limited" and len(t) == 200 and not t.endswith("。")} | {1002}
    rates = {r.source: (r.n_documents, r.n_cut) for r in cuts.cut_rates(df).collect()}
    assert rates[""] == (1, 1) and rates["free"] == (301, 0)
    assert cuts.find_cuts(df.limit(0)).count() == 0


def test_long_last_token_is_read_whole(spark):
    df = spark.createDataFrame([("见 https://example.com/" + "a/" * 200 + "\n",), ("说完了 #" + "话题" * 120,), ("see https://example.com/" + "b" * 300 + " and the",)], "t string")
    assert [r[0] for r in df.select(cuts.ending(F.col("t"))).collect()] == ["link", "tag", "open"]


def test_rules_of_a_cut(spark):
    # 300 texts reach 120 bytes, 60 of them were cut there, a third of these inside a character
    rows = [(i, "字" * (40 - i % 2) + ("�" if i % 2 else ""), "s") for i in range(60)]
    rows += [(100 + i, "完" * (30 + i % 60) + "。", "s") for i in range(240)]
    rows += [(900, "停在半路，因为", "s"), (901, None, "s"), (None, "停在半", "s"), (902, "  ", None), (903, "一句话。", None)]
    got = {r.doc_id: r.rule for r in cuts.find_cuts(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert {i: got.get(i) for i in range(60)} == {i: "limit" for i in range(60)} and got[900] == "transfer"
    assert not set(got) & set(range(100, 340)) and not set(got) & {901, 902, 903}
