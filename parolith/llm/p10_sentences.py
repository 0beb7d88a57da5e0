"""Problem 10: sentences of texts in any language and script.

A pushdown automaton reads each text. One stack holds open quotations and brackets, with the open places of each mark beside
it, so a closing mark finds its opener at once however deep the nesting is; another holds the list levels. A level is opened by a
line that begins with a bullet or with an enumerator that starts counting, goes on with the next item of the same kind, and is
closed by a blank line or by an item of a level further out; each item begins a sentence, and an enumerator's full stop ends none.
Marks inside a quotation or bracket end no sentence; a quotation belongs to the sentence it stands in. At the ground level each mark that may end a sentence is judged by what stands around it: the
abbreviation trie (walked backwards from the full stop), initials, decimals, ordinals before a month, and the first
letter that follows. Marks of scripts without capitals end a sentence by themselves; in Thai and its neighbours, which have
no such mark, a blank between two letters does. A line feed ends one unless the line was wrapped, that is, the next
word would not have fitted on it; a blank line always does.

Offsets are code points, from the first to after the last character of a sentence; every character that is not white
space belongs to exactly one sentence. One narrow pass, no shuffle. Null and blank texts give no row, whatever their
length texts are read whole, an empty table gives an empty one, other columns take no part.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parolith.llm.common import not_blank, quoted, with_id

#: Abbreviations that stand before what they belong to; the sentence goes on after them.
BEFORE = """
dr mr mrs ms mx sr srs prof st mt rev hon gen col capt lt sgt gov sen rep pres messrs cf eds al vs e.g i.e c.f dept approx
hr fr frl bzw vgl evtl ggf zzgl inkl sog dipl z.b d.h u.a s.o mme mlle mgr env p.ex av ste
sra srta srtas dra dres sres gral p.ej dott dottssa sig sigg sig.ra sig.na sig.ri avv geom rag ad.es n.b exmo exma sras drs profa
dhr mevr mw bijv bv o.a d.w.z t.w.z resp doç yrd sn örn bkz
проф акад доц им см напр т.е т.н гр тов
д د أ م ص ج
डॉ श्री प्रो
ดร นพ พญ ผศ รศ ศ พ ค
""".split()
#: Abbreviations that go on only if a number follows; elsewhere they are words like others ("No.", "mar.", "fig.").
NUMBERED = """
no nos nr vol vols fig figs ver ed ch sec art pp p ca bd bde abb tab str abs n núm núms pág págs cap tel pag pagg chap blz s jl hz yy
jan feb mar apr jun jul aug sep sept oct nov dec avr juil févr janv déc ene abr ago dic gen mag giu lug set ott okt dez
стр рис табл гл г руб коп тыс पृ सं
""".split()
#: Abbreviations that may also be the last word of a sentence; they end it where a sentence can begin next.
EITHER = "etc usw enz ecc vb т.д т.п др p.m a.m u.s.w co inc ltd corp u.k u.s bros jr i.p".split()
#: Month names before which a number with a full stop is an ordinal.
MONTHS = set(
    "januar jänner februar märz april mai juni juli august september oktober november dezember ocak şubat mart nisan mayıs haziran temmuz ağustos eylül ekim kasım aralık".split()
)
#: Thai words that open a clause the main clause follows after a blank, and words that go on with the clause before.
THAI_OPENERS = ("ถ้า", "หาก", "เมื่อ", "ที่ใด", "ใครที่", "แม้", "เพราะ", "ขณะที่", "ก่อนที่", "หลังจาก", "เพื่อ")
THAI_JOINERS = ("ที่นั่น", "ก็", "จึง", "แต่", "แล้ว", "และ", "หรือ", "เพราะ", "โดย", "ซึ่ง", "อันที่")
_OPEN = {"(": ")", "[": "]", "{": "}", "（": "）", "［": "］", "【": "】", "「": "」", "『": "』", "《": "》", "〈": "〉", "«": "»", "„": "“”", "“": "”", "‘": "’", "‹": "›", "»": "«"}
_QUOTES = set("\"'“”„‘’«»‹›「」『』")
_CLOSERS = set(")]}）］】」』》〉»”’›\"'")
_EVENT = re.compile(r"""["'“”„‘’«»‹›「」『』《》〈〉()\[\]{}（）［］【】]|\n[^\S\n]*\n""")
_ALONE = "。！？｡।॥؟۔։።፧"
_ENDS = re.compile(rf"[.!?…{_ALONE}]+(?:\s?[.!?…]+)*")
_BLANKLESS = r"฀-ໟༀ-࿿က-႟ក-៿"
_GAP = re.compile(rf"(?<=[{_BLANKLESS}])(?<![ๆ])[^\S\n]+(?=[{_BLANKLESS}\"'“«‘A-ZÀ-ÞА-Я])")
_BREAK = re.compile(r"(?<![^\S\n])[^\S\n]*\n\s*")
#: A blank line, or the enumerator or bullet that a line begins with.
_ITEM = re.compile(r"(?m)^[^\S\n]*(?:(?P<gap>$)|(?:(?P<count>[0-9]{1,3}|[a-z])(?P<close>[.)])|(?P<bullet>[•·▪*–—-]))(?=[^\S\n]+\S))")
_CJK = re.compile(r"[⺀-〿぀-ヿ㐀-鿿豈-﫿＀-￯]")
_WORD, _SOLID, _SPACE = re.compile(r"\w+"), re.compile(r"\S*"), re.compile(r"\s*")
_WORDS_OF_ONE = set("яиaoyeéàèuIОЯИ")


class AbbreviationTrie:
    """Abbreviations spelled backwards, blanks and inner stops left out of account; ``at`` walks back from a full stop."""

    def __init__(self, before: list[str], numbered: list[str], either: list[str]):
        self.root: dict = {}
        for kind, ws in (("number", numbered), ("before", before), ("either", either)):
            for w in ws:
                node = self.root
                for ch in reversed(w.replace(".", "")):
                    node = node.setdefault(ch, {})
                node[""] = kind  # of two kinds the later one
                node["parts"] = w.count(".") + 1

    def at(self, text: str, stop: int) -> str:
        """"before", "number", "either" or "": the abbreviation that ends at the full stop at this place."""
        node, i, kind, parts = self.root, stop - 1, "", 1
        while i >= 0:
            ch = text[i].lower()
            if ch in node and len(ch) == 1:
                node = node[ch]
                i -= 1
                if "" in node and parts == node["parts"] and (i < 0 or not (text[i].isalnum() or "̀" <= text[i] <= "ͯ" or "ऀ" <= text[i] <= "๏" and text[i] not in "।")):
                    kind = node[""]
            elif ch in ". \n" and node is not self.root and stop - i < 12:
                parts += ch == "."
                i -= 1
            else:
                break
        return kind


_TRIE = AbbreviationTrie(BEFORE, NUMBERED, EITHER)


def _spans(text: str) -> list[tuple[int, int]]:
    """Outermost matched quotations and brackets as (place of the opener, place of the closer); none reaches over a blank line."""
    stack: list[tuple[str, int]] = []
    awaited: dict[str, list[int]] = {}  # closing mark -> its open places in the stack
    pairs = []
    n = len(text)
    for m in _EVENT.finditer(text):
        ch, i = m.group()[0], m.start()
        if ch == "\n":
            stack.clear()
            awaited.clear()
            continue
        prev, nxt = text[i - 1] if i else " ", text[i + 1] if i + 1 < n else " "
        if ch in "'’" and prev.isalnum() and nxt.isalnum():
            continue  # an apostrophe
        open_at = awaited.get(ch)
        at = open_at[-1] if open_at else None
        opens = ch in _OPEN or ch in "\"'"
        if ch in "\"'" or ch in "»“":
            starts = (prev.isspace() or prev in "([{—–-:¿¡「（“«\"" or i == 0 or (at is None and not prev.isalnum() and prev not in ".,!?…")) and not nxt.isspace()
            if ch == "'" and not (starts and nxt.isalpha()) and at is None:
                continue
            if ch in "»“" and at is None and (ch != "“" and not starts):
                continue
            opens = at is None if ch not in "\"'" else starts and at is None or at is None
            if ch == '"' and at is not None and starts and not prev.isspace() is True:
                opens = False
        if at is not None and not (opens and ch in _OPEN and ch not in "»“"):
            pairs.append((stack[at][1], i))
            while len(stack) > at:
                for closer in stack.pop()[0]:
                    awaited[closer].pop()
        elif opens:
            closers = _OPEN.get(ch, ch)
            for closer in closers:
                awaited.setdefault(closer, []).append(len(stack))
            stack.append((closers, i))
    pairs.sort()
    out: list[tuple[int, int]] = []
    for a, b in pairs:
        if not out or a > out[-1][1]:
            out.append((a, b))
    return out


def list_items(text: str) -> dict[int, int]:
    """Place of each list item's first character -> place after its enumerator or bullet; a level of one item is no list.

    Numbers count up from 1 and letters from a; another number or letter at the beginning of a line was only wrapped there.
    """
    levels: list[tuple[str, int, list[tuple[int, int]]]] = []  # (kind of mark, last count, items)
    found: list[list[tuple[int, int]]] = []
    for m in _ITEM.finditer(text):
        if m.group("gap") is not None:
            levels.clear()
            continue
        sign = m.group("bullet") or m.group("count")
        count = 0 if m.group("bullet") else int(sign) if sign.isdigit() else ord(sign) - 96
        kind = sign if not count else ("1" if sign.isdigit() else "a") + m.group("close")
        while levels and count != 1 and any(kind == k for k, _, _ in levels[:-1]) and levels[-1][0] != kind:
            levels.pop()  # an item of a level further out closes those within
        place = (m.start("bullet") if not count else m.start("count"), m.end())
        if levels and levels[-1][0] == kind and count != 1:
            if not count or count == levels[-1][1] + 1:
                levels[-1][2].append(place)
                levels[-1] = (kind, count, levels[-1][2])
        elif count <= 1:
            levels.append((kind, count, [place]))
            found.append(levels[-1][2])
    return dict(place for items in found if len(items) > 1 for place in items)


def _begins(text: str, i: int) -> str:
    """What follows at i: "lower", "upper", "digit", "other" (a letter without case), "mark" or "end"; opening marks are looked through."""
    n = len(text)
    while i < n and (text[i].isspace() or text[i] in "\"'“„‘«‹「『(（[【¿¡—–-•*"):
        i += 1
    if i >= n:
        return "end"
    ch = text[i]
    return "lower" if ch.islower() else "upper" if ch.isupper() or ch.istitle() else "digit" if ch.isdigit() else "other" if ch.isalpha() else "mark"


def _ends_here(text: str, s: int, e: int) -> bool:
    """Whether the marks at [s, e), at the ground level, end a sentence."""
    n = len(text)
    k = e
    while k < n and text[k].isspace():
        k += 1
    if k >= n or "\n" in text[e:k] and text[e:k].count("\n") > 1:
        return True
    gap, nxt = text[e:k], text[k]
    mark = text[s:e]
    if nxt in ",;:，、；：":
        return False
    follows = _begins(text, k)
    if any(c in _ALONE for c in mark):
        return follows != "lower"
    if mark[0] in "!?":
        return bool(gap) or follows in ("upper", "other")
    if len(mark) > 1 or mark == "…":
        return follows not in ("lower", "mark") and (bool(gap) or follows in ("upper", "other")) or bool(gap) and follows == "mark" and nxt not in ")]»”"
    i = s
    while i > 0 and (text[i - 1].isalnum() or "̀" <= text[i - 1] <= "ͯ" or "ऀ" <= text[i - 1] <= "๏" and text[i - 1] not in "।॥"):
        i -= 1
    word = text[i:s]
    kind = _TRIE.at(text, s)
    if follows == "lower":  # a sentence that begins small, after a word that is no abbreviation
        return bool(gap) and not kind and len(word) > 3 and word.isalpha() and word.islower()
    if not gap:
        if word.isdigit() and follows == "digit" or kind or len(word) < 3 and not word.isdigit():
            return False
        return follows in ("upper", "other") or follows == "digit" and word.isalpha() and word.islower() and len(word) > 2 or nxt in "\"«“„¿¡" and follows == "upper"
    if kind == "before" or kind == "number" and follows == "digit":
        return False
    if kind == "either":
        return follows in ("upper", "digit", "other")
    if len(word) == 1 and word.isalpha() and word not in _WORDS_OF_ONE and not _CJK.match(word):
        return False
    if word.isdigit() and len(word) < 4:
        m = _WORD.match(text, k)
        if m and m.group().lower() in MONTHS or text[max(0, i - 8) : i].rstrip(" \t(")[-1:] in ("\n", ""):
            return False
    return True


def _wrapped(text: str, start: int, end: int, width: int) -> bool:
    """Whether the line feed run at [start, end) only wraps a line: the next word would not have fitted."""
    line = text[text.rfind("\n", 0, start) + 1 : start]
    nxt = _SOLID.match(text, end).group()
    if nxt[:1].islower():
        return True
    size = 1 if _CJK.match(nxt) else len(nxt)
    return len(line.rstrip()) + (0 if _CJK.match(nxt) else 1) + size > width


def sentences(text: str | None) -> list[tuple[int, int]]:
    """(start, end) of each sentence in code points."""
    if not text or text.isspace():
        return []
    spans = _spans(text)
    cuts: list[int] = []
    k = 0
    inside = [(a, b) for a, b in spans]

    def covered(i: int) -> tuple[int, int] | None:
        nonlocal k
        while k < len(inside) and inside[k][1] < i:
            k += 1
        return inside[k] if k < len(inside) and inside[k][0] < i <= inside[k][1] else None

    items = list_items(text)
    enumerators = {e - 1 for e in items.values()}
    gap_after = -1  # where the sentence begins that had the last gap between letters of a script without blanks

    def solid(at: int) -> int:
        """The first place from there on that isn't white space."""
        return _SPACE.match(text, at).end()

    width = max(len(x.rstrip()) for x in text.split("\n"))
    events = [(m.start(), m.end(), 0) for m in _ENDS.finditer(text)] + [(m.start(), m.end(), 1) for m in _BREAK.finditer(text)] + [(m.start(), m.end(), 2) for m in _GAP.finditer(text)]
    events += [(b, b + 1, 3) for a, b in spans]
    events.sort()
    opened = {b: a for a, b in spans}
    for s, e, kind in events:
        if kind == 3:
            a = opened[s]
            before = text[a + 1 : s].rstrip()[-1:]
            if before and before in ".!?…" + _ALONE:
                j = e
                while j < len(text) and text[j] in _CLOSERS and not text[j].isspace():
                    j += 1
                follows = _begins(text, j)
                nxt = text[j : j + 1]
                if nxt and nxt in ",;:，、；：.!?…" + _ALONE:
                    continue
                whole = solid(cuts[-1] if cuts else 0) >= a
                if follows in ("upper", "digit", "other") and nxt.isspace() or follows == "end":
                    cuts.append(j)
                elif follows == "other" and whole and nxt and nxt not in "とって" and text[j : j + 8].lstrip()[:1] not in ("と", "っ"):
                    cuts.append(j)
            continue
        if kind == 2:
            start = cuts[-1] if cuts else 0
            first = gap_after != start
            gap_after = start
        if covered(s):
            if kind == 1 and text[s:e].count("\n") > 1:
                cuts.append(s)
            continue
        if kind == 0:
            if s in enumerators:
                continue
            j = e
            while j < len(text) and text[j] in ")]}）］】」』》〉»”’›" :
                j += 1
            if _ends_here(text, s, e):
                cuts.append(j)
        elif kind == 2:
            nxt = text[e : e + 1]
            if text.startswith(THAI_JOINERS, e) or first and text.startswith(THAI_OPENERS, solid(start)):
                continue
            if nxt not in "\"'“«‘" or _begins(text, e) == "upper":
                cuts.append(s)
        else:
            if cuts and solid(cuts[-1]) >= s:
                continue
            if e in items or text[s:e].count("\n") > 1 or not _wrapped(text, s, e, width):
                cuts.append(s)
            elif _GAP.search(text[max(0, s - 1) : s] + " " + text[e : e + 1]):
                cuts.append(s)
    out = []
    at = 0
    for c in [*sorted(set(cuts)), len(text)]:
        part = text[at:c]
        body = part.strip()
        if body:
            start = at + len(part) - len(part.lstrip())
            if out and not any(ch.isalnum() for ch in body) and "\n" not in text[out[-1][1] : start]:
                out[-1] = (out[-1][0], start + len(body))  # a mark left alone belongs to what it follows
            else:
                out.append((start, start + len(body)))
        at = c
    return out


_OUT = T.StructType([T.StructField("id", T.LongType()), T.StructField("seq", T.IntegerType()), T.StructField("start_pos", T.IntegerType()), T.StructField("end_pos", T.IntegerType()), T.StructField("sentence", T.StringType())])


def split_sentences(df: DataFrame, id_col: str, text_col: str, with_text: bool = True) -> DataFrame:
    """(id, seq, start_pos, end_pos, sentence) of every text; sentence is null if with_text is False."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for at in range(0, len(whole), 1000):
                p = whole.iloc[at : at + 1000]
                rows = [(ident, k, a, b, text[a:b] if with_text else None) for ident, text in zip(p["id"].tolist(), p["text"]) for k, (a, b) in enumerate(sentences(text))]
                yield pd.DataFrame(rows, columns=[f.name for f in _OUT]).astype({"id": "int64", "seq": "int32", "start_pos": "int32", "end_pos": "int32"})

    picked = with_id(df, id_col).select(quoted(id_col).cast("long").alias("id"), quoted(text_col).cast("string").alias("text")).where(not_blank(F.col("text")))
    return picked.mapInPandas(run, _OUT)
