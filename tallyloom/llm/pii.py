"""Personal information in free text: find it, replace it by typed placeholders.

An Aho-Corasick automaton finds anchors: at-signs, URL schemes, digits, house
number and road words, cues that announce a number or a person, given names.
From the position of each anchor a parser of its kind expands to the left and
right, and validates what it met by shape, check digits and the words around.
Names are scored: cue before, cue after and shape must together suffice.
Parsing runs on a folded view of the text with a map back to the original
positions, so full-width forms, look-alike letters and invisible characters
hide nothing, and all else of the text stays as it is.
"""

from __future__ import annotations

import datetime
import re
import unicodedata
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.canon import LOOKALIKES, _invisible, segments

PLACEHOLDERS = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "street_address": "[ADDRESS]", "person_name": "[NAME]"}

#: Family names by frequency of use, and double ones.
SURNAMES = "王李张刘陈杨黄赵吴周徐孙马朱胡郭何林高罗郑梁谢宋唐许韩邓冯曹彭曾肖田董潘袁蔡蒋余于杜叶程魏苏吕丁任卢姚沈钟姜崔谭陆范汪廖石金韦贾夏付方邹熊白孟秦邱侯江尹薛闫段雷龙黎史陶贺毛郝顾龚邵万覃武钱戴严莫孔向常汤温康施文牛樊葛邢安齐易乔伍庞颜倪庄聂章鲁岳翟殷詹申欧耿关兰焦俞左柳甘祝包宁尚符舒阮柯纪梅童凌毕单季成霍涂苗裴翁甄祁桑柏岑骆简卓冷闻"
DOUBLE_SURNAMES = ("欧阳", "司徒", "上官", "诸葛", "司马", "皇甫", "夏侯", "尉迟", "长孙", "慕容", "令狐", "宇文", "公孙", "端木", "东方", "南宫", "独孤")
#: Titles that make a family name a role.
TITLES = "老师|律师|先生|女士|小姐|主任|医生|师傅|同学|教授|警官|经理|阿姨|叔叔|大爷|大妈|大叔|书记|局长|所长|法官|检察官|主播|老板|队长|主持人|导演"
_NUMERALS = dict(zip("零〇一二三四五六七八九幺", "001234567891"))
_NUMERAL_TABLE = str.maketrans(_NUMERALS)

#: Cues before a number that is nobody's, and words after one. A cue ends where
#: the number begins, but for a mark or a word like "is" between.
_NOT_BEFORE = re.compile(r"(播放量?|浏览量?|阅读量?|点赞|订单号?|单号|快递单?号?|运单号?|视频号?编号|编号|视频|版本号?|回复|看了|截至|第|报名费|金额|价格|共计|楼层|邮编|期号|热线(电话)?|客服(电话)?|\bno\.?|\bpost|\breply|\bcopy|\borders?|\brated|\btracking|\bparcel|\broom|\bversion|\bsee v|\bv|\bvideo|\binvoice|\bticket|\bhotline|\bhelpline|\b(order|tracking|video|parcel) (no\.?|number|id)|[$¥€£])$", re.I)
_NOT_AFTER = re.compile(r"\s?(次|遍|楼|条|元|%|万|亿|人次|票|块|播放|views\b|people\b|likes\b|replies\b|votes\b)", re.I)
_ID_CUE = re.compile(r"(身份证号?码?|证件号?码?|sfz|实名|号码|身份号码|\bssn|\bsocial( security)?( number| no\.?)?|\bid( no\.?| number)?|\bnational id|\btax id)$", re.I)
_PHONE_CUE = re.compile(r"(电话|手机号?|短信|同号|微信|致电|拨打|打我|联系方式|联系|本人|\bcall( me)?( on| at)?|call我|\btext( me)?( on| at)?|\bring|\bnumber|\bphone|\btel\.?|\bmobile|\bcell|\bwhatsapp|\bdial|\breach me (on|at))$", re.I)
_BETWEEN = re.compile(r"(?:\bis|是|为|[#:：])$", re.I)
_LONGEST_CUE = 32
_PASS_AFTER = re.compile(r"\s*(?:号码?|no\.?|number|num\.?)?\s*(?:is|是|为)?\s*[#:：]?\s*(?P<n>[A-Za-z]{1,2}\s?[0-9]{7,9})(?![0-9A-Za-z])", re.I)

_AT = re.compile(r"\s?(?:@|[(\[{#]\s?at\s?[)\]}#]|(?<= )(?:AT|at)(?= ))\s?", re.I)
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOT = r"(?:\.|\s?[(\[{#]\s?dot\s?[)\]}#]\s?|\sdot\s)"
_DOMAIN = re.compile(rf"[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?(?:{_DOT}[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?)*?{_DOT}[A-Za-z]{{2,12}}(?![A-Za-z0-9\-])(?:{_DOT}[A-Za-z]{{2,12}}(?![A-Za-z0-9\-]))*", re.I)
_URL = re.compile(r"(?:https?://|www\.)[!-~]+", re.I)
_NUMBER = re.compile(r"(?<![0-9A-Za-z._])(?:\+\s?|\()?[0-9](?:[ \-.()]{0,2}[0-9])*[Xx]?(?![0-9A-Za-z])")
_SPELLED = re.compile(r"(?<![零〇一二三四五六七八九幺])1?[零〇一二三四五六七八九幺]{11}(?![零〇一二三四五六七八九幺])")
_ROAD = r"(?:大道|大街|马路|胡同|路|街|巷|弄)"
_COUNT = r"[0-9一二三四五六七八九十百零〇]{1,6}"
_COUNTED = frozenset("0123456789一二三四五六七八九十百零〇")
_HAN_ADDRESS = re.compile(rf"(?:[一-鿿]{{2,6}}?[省市县])?(?:[一-鿿]{{2,4}}?[区镇乡])?(?P<road>[一-鿿]{{1,6}}?{_ROAD})\s?{_COUNT}\s?(?:号|弄)(?!线|楼的人)(?:\s?院内?|\s?{_COUNT}\s?(?:栋|幢|座|单元|室|楼|层|号楼|号)|(?<=单元)\s?[0-9]{{2,4}})*")
_LEAD = re.compile(r"^(?:就住在?|住在?|搬到|寄到|送到|地址(?:是|在)?|家在|人在|来到?|在|到|去)+")
_STREET = r"(?:Street|Lane|Avenue|Close|Road|Drive|Court|Way|Terrace|Place|Boulevard|Row|Gardens|Crescent|Square|St|Ave|Rd|Ln|Dr|Blvd)"
_ENG_ADDRESS = re.compile(rf"(?<![0-9A-Za-z])[0-9]{{1,5}}[A-Za-z]?,?\s+(?:[A-Z][A-Za-z'\-]*\s+){{1,3}}{_STREET}\b\.?(?:,?\s+(?:Apt|Flat|Unit|Suite)\.?\s+[0-9]+[A-Za-z]?)?(?:,\s+[A-Z][a-z]{{3,}}(?![a-z])(?!\s+[A-Z]))?")
_ENG_CUED = re.compile(rf"(?:live at|come to|post it to|send it to|address is|address:)\s+(?P<a>[0-9]{{1,5}}[A-Za-z]?,?\s+(?:[A-Za-z][A-Za-z'\-]*\s+){{1,3}}{_STREET}\b\.?)", re.I)
_CAP = r"[A-ZÀ-ÖØ-Þ][\wÀ-ÿ'’\-]*"
_CALLE = re.compile(rf"(?:Calle|Avenida|Plaza|Paseo)\s+(?:(?:de|del|la|las|los|el)\s+)*{_CAP}(?:\s+{_CAP})*,?\s+(?:n[.º°]+\s*)?[0-9]{{1,4}}\b")
_RUE = re.compile(rf"(?<![0-9A-Za-z])[0-9]{{1,4}}(?:\s?(?:bis|ter))?,?\s+(?:rue|avenue|boulevard|quai|chemin|impasse|allée)\s+(?:(?:de|du|des|de la|la|le|les|d')\s*)*{_CAP}(?:[\s\-]{_CAP})*")
_STRASSE = re.compile(r"[A-ZÄÖÜ][a-zäöüß\-]*(?:straße|strasse|str\.|gasse|allee|weg|platz)\s+[0-9]{1,4}(?:\s?[a-z])?\b")

_FAMILY = f"(?:{'|'.join(DOUBLE_SURNAMES)}|[{SURNAMES}])"
#: Common words whose first character is also a family name.
_NO_NAME = frozenset("方式 方便 方面 方法 方案 方向 高兴 高度 高速 时间 马上 马路 金额 金融 任何 任务 常常 常见 平台 白天 安全 安排 万一 向来 单位 单独 成为 成功 江湖 张罗 文章 文件 文化 文明 史上 武器 钱包 钟头 夏天 程序 程度 段落 关于 关系 关注 关键 于是 余下 石头 雷达 毛病 龙头 包括 包裹 纪念 纪录 甘心 童年 季度 温度 施工 施行 牛奶 易于 严重 严格 严惩 何必 何况 何时 路边 路口 明天 明白 管理 管家 谢谢 许多 许可 曾经 田地 孔子 连续 黄色 黄金 白色 左右 左边 古代 游戏 强制 强调 解释 解决 池塘 党员 华人 全部 全国 车主 车辆 水平 祝福 祝你 应该 应当 平时 平均 和谐 冷静 冷漠 简单 简直 章程 乔装 凌晨 毕竟 毕业 符合 尚未 尚可 宁可 宁愿 梅花 欧洲 申请 申诉 耿直 焦虑 舒服 包容".split())
#: Cues of a person before and after a name; one of the second kind needs another.
_HAN_BEFORE = ("我叫", "名叫", "本名", "联系人", "当事人", "实名举报", "举报人", "姓名", "署名", "签名")
_HAN_BEFORE_WEAK = ("昨天", "今天", "前天", "刚才", "后来", "找", "联系", "通知", "感谢", "认识", "同学", "同事", "邻居", "朋友", "室友", "同桌", "老乡")
_HAN_AFTER = re.compile(r"本人(?!是)")
_HAN_AFTER_WEAK = re.compile(r"在|要|被|吧|说|把|家住|住在|签了|拍的|报了?警|的(?:号码|电话|手机|微信|地址|住址)")
_HAN_LINK = re.compile(r"(?:就是|是|为|叫)?\s?[::]?\s?")
_HAN_NAME = re.compile(rf"{_FAMILY}(?!{TITLES})[一-鿿]{{1,2}}")
_HAN_TITLE = re.compile(TITLES)

#: Common given names.
GIVEN = frozenset("james mary robert patricia john jennifer michael linda david elizabeth william barbara richard susan joseph jessica thomas sarah charles karen christopher lisa daniel nancy matthew betty anthony margaret mark sandra donald ashley steven kimberly paul emily andrew donna joshua michelle kenneth carol kevin amanda brian dorothy george melissa edward deborah ronald stephanie timothy rebecca jason sharon jeffrey laura ryan cynthia jacob kathleen gary amy nicholas angela eric shirley jonathan anna stephen brenda larry pamela justin emma scott nicole brandon helen benjamin samantha samuel katherine gregory christine frank debra alexander rachel raymond olivia patrick carolyn jack janet dennis catherine jerry maria tyler heather aaron diane jose josé julie adam joyce henry victoria nathan kelly peter christina juan carlos luis antonio manuel francisco pedro miguel rafael javier sofía lucía carmen isabel elena martín ana pablo alejandro diego".split())
_ENG_CAP = r"(?:[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ'’\-]+|[A-ZÀ-ÖØ-Þ]{2,})"
_ENG_NAME = re.compile(rf"(?!(?:The|This|That|Old|New|My|Your|And|For|Not|Dear|All|Best|Kind|Sir|Madam)\b){_ENG_CAP}\s+(?:[A-Z]\.\s+)?{_ENG_CAP}(?:\s+{_ENG_CAP}(?=\s+(?:signed|who)))?(?!\s+{_STREET}\b)(?![\w])")
_ENG_BEFORE = ("my name is", "name:", "i am called", "regards,", "sincerely,", "yours,", "ask for", "speak to", "contact person:", "contact person", "report")
_ENG_BEFORE_RE = re.compile(r"(?:^|\W)(?:my name is|name:|i am called|regards,|sincerely,|yours,|ask for|speak to|contact person:?|report)\s+$", re.I)
_ENG_BEFORE_WEAK_RE = re.compile(r"(?:^|\W)(?:reach|met|meet|told|tell|with|by|from|know|knows|named|saw|and|it was|this is|i am|i'm|contact|thank|thanks)\s+$", re.I)
_ENG_AFTER = (" signed", " who ", " lives at", " lives in", " was ")
_ENG_AFTER_RE = re.compile(r"\s+(?:signed (?:the|it|this)|who [a-z]+ed\b|lives (?:at|in|on)|was [a-z]+ly\b)", re.I)
_ENG_AFTER_WEAK_RE = re.compile(r"(?:'s (?:number|phone|address|house|car)|\s+(?:who|phoned|called|texted|emailed|said|says|told|wrote|filmed|works|visited|on|at)\b)", re.I)
_TOKEN_BACK = re.compile(r"\S+\s*$")

#: What the automaton looks for, by the parser it calls.
_ANCHORS = {
    "email": ["@", "(at)", "( at )", "[at]", "[ at ]", "{at}", "{ at }", "#at#", " at "],
    "url": ["http://", "https://", "www."],
    "number": [*"0123456789"],
    "spelled": [*_NUMERALS],
    "passport": ["护照", "通行证", "港澳证", "台胞证", "居留证", "passport", "permit"],
    "han_address": ["号", "弄"],
    "eng_address": [" street", " lane", " avenue", " close", " road", " drive", " court", " way", " terrace", " place", " boulevard", " row", " gardens", " crescent", " square", " st", " ave", " rd", " ln", " dr", " blvd"],
    "calle": ["calle ", "avenida ", "plaza ", "paseo "],
    "rue": [" rue ", " avenue ", " boulevard ", " quai ", " chemin ", " impasse ", " allée "],
    "strasse": ["straße ", "strasse ", "str. ", "gasse ", "allee ", "weg ", "platz "],
    "han_after": [*_HAN_BEFORE, *_HAN_BEFORE_WEAK],
    "han_before": ["本人"],
    "eng_after": list(_ENG_BEFORE),
    "eng_before": list(_ENG_AFTER),
    "eng_given": sorted(GIVEN),
}
_machine = None


def _automaton():
    global _machine
    if _machine is None:
        kinds: dict[str, list[str]] = {}
        for kind, words in _ANCHORS.items():
            for w in words:
                kinds.setdefault(w, []).append(kind)
        a = ahocorasick.Automaton()
        for w, k in kinds.items():
            a.add_word(w, (w, k))
        a.make_automaton()
        _machine = a
    return _machine


def _lowered(t: str) -> str:
    low = t.lower()
    return low if len(low) == len(t) else "".join(c.lower() if len(c.lower()) == 1 else c for c in t)


_folds: dict[str, str] = {}


def _fold_char(c: str) -> str:
    hit = _folds.get(c)
    if hit is None:
        t = unicodedata.normalize("NFKC", c)
        t = "".join(" " if unicodedata.category(x) == "Zs" else LOOKALIKES.get(x, x) for x in t if not _invisible(x))
        hit = _folds[c] = t if len(t) <= 1 else c
    return hit


def folded(text: str) -> tuple[str, list[int] | None]:
    """The text as parsed and, unless positions agree, each character's place in the original."""
    if text.isascii() or not segments().search(text):
        return text, None
    out, at = [], []
    for i, c in enumerate(text):
        f = c if c < "\x7f" else _fold_char(c)
        if f:
            out.append(f)
            at.append(i)
    at.append(len(text))
    return "".join(out), at


def _date_ok(digits: str) -> bool:
    try:
        return 1900 <= datetime.date(int(digits[6:10]), int(digits[10:12]), int(digits[12:14])).year <= 2035
    except ValueError:
        return False


def _check_digit_ok(d: str) -> bool:
    """ISO 7064 MOD 11-2 over the 18 characters of a resident number."""
    return "10X98765432"[sum(int(c) * (2 ** (17 - i) % 11) for i, c in enumerate(d[:17])) % 11] == d[17].upper()


def _cue_window(t: str, at: int) -> str:
    """What ends before ``at``, without white space and a linking mark or word, as long as a cue may be."""
    j = at
    while j and t[j - 1].isspace():
        j -= 1
    link = _BETWEEN.search(t, max(0, j - 3), j)
    if link:
        j = link.start()
        while j and t[j - 1].isspace():
            j -= 1
    return t[max(0, j - _LONGEST_CUE) : j]


def _number_kind(raw: str, before: str, t: str, end: int) -> str | None:
    """phone, id_number or neither, by shape and by the words around."""
    id_cue = bool(_ID_CUE.search(before))
    # "id no." announces a person's number, "no." alone does not
    if not id_cue and _NOT_BEFORE.search(before) or _NOT_AFTER.match(t, end):
        return None
    d = re.sub("[^0-9Xx]", "", raw)
    if len(d) == 18 and d[:17].isdigit():
        return "id_number" if id_cue or _date_ok(d) and _check_digit_ok(d) else None
    if d[-1] in "Xx":
        return None
    if re.fullmatch(r"[0-9]{3}[- ][0-9]{2}[- ][0-9]{4}", raw) or len(d) in (9, 15) and id_cue:
        return "id_number"
    body = d
    for p in ("0086", "86"):
        if body.startswith(p) and len(body) == 11 + len(p):
            body = body[len(p) :]
    if len(body) == 11 and body[0] == "1" and body[1] in "3456789":
        return "phone"
    if raw.lstrip().startswith("+") and 8 <= len(d) <= 15:
        return "phone"
    if re.fullmatch(r"\(?0[0-9]{2,3}\)?[- ]?[0-9]{7,8}(-[0-9]{1,5})?", raw) and 10 <= len(d) <= 17:
        return "phone"
    if re.fullmatch(r"07[0-9]{3}[ -]?[0-9]{3}[ -]?[0-9]{3}|0[12][0-9]{1,4}[ -][0-9]{3,4}[ -]?[0-9]{3,4}", raw):
        return "phone"
    m = re.fullmatch(r"(?:1[-. ])?\(?([0-9]{3})\)?[-. ]{1,2}[0-9]{3}[-. ][0-9]{4}", raw)
    if m and m[1] not in ("400", "800", "888", "877", "866", "855", "844", "833"):
        return "phone"
    if 7 <= len(d) <= 12 and not d.startswith(("400", "800")) and _PHONE_CUE.search(before):
        return "phone"
    return None


# ---- parsers: from an anchor at [a, b) to a span, or None ----


def _email(t: str, a: int, b: int) -> tuple[int, int] | None:
    at = _AT.match(t, a - 1 if a and t[a - 1] == " " else a)
    if at is None or at.end() < b - 1:
        return None
    i = at.start()
    while i and t[i - 1] in _LOCAL:
        i -= 1
    while i < at.start() and not t[i].isalnum():
        i += 1
    domain = _DOMAIN.match(t, at.end())
    if i == at.start() or not (t[at.start() - 1].isalnum() or t[at.start() - 1] == "_") or domain is None:
        return None
    # a bare word "at" between words is no address
    word = at[0].strip()
    if word.lower() == "at" and word != "AT" and not re.search(r"[0-9._+\-]", t[i : at.start()]):
        return None
    return i, domain.end()


def _number(t: str, a: int) -> re.Match | None:
    """The whole number that a digit begins, with what stands before it."""
    if t[a - 1 : a] in ("(", "+"):
        a -= 1
    elif t[a - 2 : a] == "+ ":
        a -= 2
    return _NUMBER.match(t, a)


def _han_address(t: str, a: int, b: int) -> tuple[int, int] | None:
    # back over the number to the road and the place before it
    i = a
    while i and (t[i - 1] in _COUNTED or t[i - 1] == " "):
        i -= 1
    if i == a:
        return None
    lo = i
    while lo and i - lo < 20 and "一" <= t[lo - 1] <= "鿿":
        lo -= 1
    m = _HAN_ADDRESS.search(t, lo)
    if m is None or not m.start() < a < m.end():
        return None
    lead = _LEAD.match(m[0])
    road = _LEAD.sub("", m["road"])
    if len(road) < 2 or re.match(r"[这那每哪几一二两]条?[路街巷]", road):
        return None
    return m.start() + (lead.end() if lead else 0), m.end()


def _token_starts(t: str, end: int, n: int) -> list[int]:
    """Starts of the last n tokens before ``end``, the nearest first."""
    out = []
    while end and len(out) < n:
        while end and t[end - 1].isspace():
            end -= 1
        while end and not t[end - 1].isspace():
            end -= 1
        out.append(end)
    return out


def _around(pattern: re.Pattern, t: str, a: int, b: int, tokens: int, group: str | int = 0) -> tuple[int, int] | None:
    """The longest match that begins within so many tokens before an anchor and covers it."""
    for i in reversed(_token_starts(t, a + 1, tokens)):
        m = pattern.search(t, i, min(len(t), b + 200)) if i < b else None
        if m and m.start() <= a + 1 and m.end() >= b:
            return m.span(group)
    return None


def _han_person(t: str, a: int, before: int) -> tuple[int, int] | None:
    """A name that begins at ``a``, with the score of what stands before it."""
    m = _HAN_NAME.match(t, a)
    if m is None:
        return None
    best = None
    family = 2 if t[a : a + 2] in DOUBLE_SURNAMES else 1
    for end in range(m.end(), a + family, -1):
        if t[a : a + 2] in _NO_NAME or end < m.end() and _HAN_TITLE.match(t, end):
            continue
        # "王小明老师" is a role after "王小明" too; one character less is no name then
        given = t[a + family : end]
        if len(given) == 2 and _HAN_TITLE.match(t, end - 1):
            continue
        after = 2 if _HAN_AFTER.match(t, end) else 1 if _HAN_AFTER_WEAK.match(t, end) else 0
        if before + after >= 2 and (best is None or before < 2 and before + after > best[0]):
            best = (before + after, end)
    return (a, best[1]) if best else None


def _eng_person(t: str, a: int, covering: int | None = None) -> tuple[int, int] | None:
    """A name that begins at ``a`` and, if given, ends there; cues and shape must suffice."""
    if a and (t[a - 1].isalnum() or t[a - 1] in "'’-"):
        return None
    m = _ENG_NAME.match(t, a)
    if m is None or covering is not None and m.end() != covering:
        return None
    window = t[max(0, a - 24) : a]
    before = 2 if _ENG_BEFORE_RE.search(window) else 1 if _ENG_BEFORE_WEAK_RE.search(window) else 0
    after = 2 if _ENG_AFTER_RE.match(t, m.end()) else 1 if _ENG_AFTER_WEAK_RE.match(t, m.end()) else 0
    known = m[0].split()[0].lower() in GIVEN
    return m.span() if before + after + known >= 2 else None


_ORDER = {k: i for i, k in enumerate(("url", "email", "street_address", "number", "passport", "spelled", "person_name"))}
_HAN_STRONG = frozenset(_HAN_BEFORE)


def find(text: str | None) -> list[tuple[int, int, str]]:
    """Spans (start, end, kind) in the original text, in order, without overlap."""
    if not text:
        return []
    t, at = folded(text)
    met: list[tuple[int, int, int, str]] = []
    number_end = spelled_end = 0

    def keep(order: str, span: tuple[int, int] | None, kind: str) -> None:
        if span and span[0] < span[1]:
            met.append((_ORDER[order], *span, kind))

    for last, (word, kinds) in _automaton().iter(_lowered(t)):
        b = last + 1
        a = b - len(word)
        for kind in kinds:
            if kind == "number":
                # digits of a number already parsed are no anchors of their own
                if a < number_end:
                    continue
                m = _number(t, a)
                if m:
                    number_end = m.end()
                    keep("number", m.span(), _number_kind(m[0], _cue_window(t, m.start()), t, m.end()) or "")
            elif kind == "spelled":
                if a < spelled_end:
                    continue
                m = _SPELLED.match(t, a - 1 if t[a - 1 : a] == "1" else a)
                if m:
                    spelled_end = m.end()
                    if _number_kind(m[0].translate(_NUMERAL_TABLE), _cue_window(t, m.start()), t, m.end()) == "phone":
                        keep("spelled", m.span(), "phone")
            elif kind == "email":
                keep("email", _email(t, a, b), "email")
            elif kind == "url":
                keep("url", _URL.match(t, a).span() if _URL.match(t, a) else None, "")
            elif kind == "passport":
                m = _PASS_AFTER.match(t, b)
                keep("passport", m.span("n") if m else None, "id_number")
            elif kind == "han_address":
                keep("street_address", _han_address(t, a, b), "street_address")
            elif kind == "eng_address":
                keep("street_address", _around(_ENG_ADDRESS, t, a, b, 5) or _around(_ENG_CUED, t, a, b, 7, "a"), "street_address")
            elif kind == "calle":
                m = _CALLE.match(t, a)
                keep("street_address", m.span() if m else None, "street_address")
            elif kind == "rue":
                keep("street_address", _around(_RUE, t, a, b, 2), "street_address")
            elif kind == "strasse":
                keep("street_address", _around(_STRASSE, t, a, b, 1), "street_address")
            elif kind == "han_after":
                keep("person_name", _han_person(t, _HAN_LINK.match(t, b).end(), 2 if word in _HAN_STRONG else 1), "person_name")
            elif kind == "han_before":
                # the longest name that ends at the cue
                for n in (4, 3, 2):
                    span = _han_person(t, a - n, 0) if a >= n else None
                    if span and span[1] == a:
                        keep("person_name", span, "person_name")
                        break
            elif kind == "eng_after":
                j = b
                while j < len(t) and t[j].isspace():
                    j += 1
                keep("person_name", _eng_person(t, j), "person_name")
            elif kind == "eng_before":
                end = a
                for i in reversed(_token_starts(t, end, 3)):
                    span = _eng_person(t, i, end)
                    if span:
                        keep("person_name", span, "person_name")
                        break
            elif kind == "eng_given":
                keep("person_name", _eng_person(t, a), "person_name")
    # of overlapping spans the kind that comes first holds, then the leftmost
    met.sort()
    spans: list[tuple[int, int, str]] = []
    for _, a, b, kind in met:
        if kind and all(b <= x or a >= y for x, y, _ in spans) or kind == "" and _ == 0:
            spans.append((a, b, kind))
    spans = sorted(x for x in spans if x[2])
    if at is None:
        return spans
    return [(at[a], at[b - 1] + 1, k) for a, b, k in spans]


def redact(text: str | None) -> str | None:
    """The text with each span replaced by its kind's placeholder."""
    if not text:
        return text
    out, last = [], 0
    for a, b, kind in find(text):
        out += [text[last:a], PLACEHOLDERS[kind]]
        last = b
    return "".join([*out, text[last:]])


def find_pii(texts: DataFrame) -> DataFrame:
    """``record_table``, ``record_id``, ``pii_kind``: kinds present in each record.

    ``texts`` has record_table, record_id, text. NULL and empty texts hold
    nothing; rows with a NULL id are left out; a record delivered again counts
    once. Texts of any length are read whole.
    """
    picked = texts.select("record_table", F.col("record_id").cast("string").alias("record_id"), F.col("text").cast("string").alias("text")).filter("record_id is not null and text is not null and text <> ''")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(t, i, k) for t, i, x in zip(*(c.to_pylist() for c in b.columns)) for k in sorted({k for _, _, k in find(x)})]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], names=["record_table", "record_id", "pii_kind"])

    return picked.mapInArrow(run, "record_table string, record_id string, pii_kind string").distinct()


def redact_texts(texts: DataFrame) -> DataFrame:
    """``record_table``, ``record_id``, ``text`` with placeholders: every row, equal ones once.

    Different texts under one id, or under a NULL id, all come out. NULL and
    empty texts stay as they are.
    """
    picked = texts.select("record_table", F.col("record_id").cast("string").alias("record_id"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([redact(x) for x in b.column(2).to_pylist()], pa.string())], names=["record_table", "record_id", "text"])

    return picked.mapInArrow(run, picked.schema).distinct()
