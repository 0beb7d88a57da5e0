"""One form for texts that look the same (problem 7), and the word forms other operators compare.

Method: every character has a set of scripts it can be read in (its own, and those of letters that look like it).
Intersecting the sets over a token gives the scripts in which the whole token can be spelled. One script left: the token
is written in it. Several left (a whole-script confusable): the nearest settled tokens on both sides decide, if they
agree. None left: the token mixes scripts that do not look alike and stays. The remaining forms (wide and presentation
letters, ligatures, radicals, spaces, letter + accent stored apart, characters that cannot be seen) are then normalised.

Punctuation and symbols never change, except Kangxi and CJK radicals, which are symbols only in name.
"""

from __future__ import annotations

import re
import unicodedata as ud
from functools import lru_cache
from itertools import accumulate

import regex

#: Letters that look like a Latin letter, by script. Each pair is (letter, the Latin one).
CYRILLIC_LATIN = (
    "аa сc еe оo рp хx уy іi јj ѕs һh ԁd ԛq ԝw ӏl ѵv АA ВB СC ЕE НH ІI ЈJ КK МM ОO РP ЅS ТT ХX УY ԌG ԚQ ԜW"
)
GREEK_LATIN = "οo νv αa ρp υu ιi κk γy χx τt ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX"
GREEK_CYRILLIC = "οо αа ρр κк χх τт ΑА ΒВ ΕЕ ΗН ΚК ΜМ ΟО ΡР ΤТ ΧХ φф"
ARMENIAN_LATIN = "օo ոn սu հh ցg զq ԱU ՕO ՍU ՏS"
COPTIC_LATIN = "ⲀA ⲂB ⲎH ⲒI ⲔK ⲘM ⲚN ⲞO ⲟo ⲢP ⲣp ⲤC ⲥc ⲦT ⲨY ⲬX ⲭx"
CHEROKEE_LATIN = "ᎪA ᏴB ᏟC ᎠD ᎬE ᏀG ᎻH ᎫJ ᏦK ᏞL ᎷM ᏢP ᏒR ᏚS ᎢT ᏙV ᎳW ᎩY ᏃZ"
LISU_LATIN = "ꓮA ꓐB ꓚC ꓓD ꓰE ꓝF ꓖG ꓧH ꓲI ꓙJ ꓗK ꓡL ꓟM ꓠN ꓳO ꓑP ꓣR ꓢS ꓔT ꓴU ꓦV ꓪW ꓫX ꓬY ꓜZ"
#: A form of a Greek letter that looks like a Latin one (and over that like a Cyrillic one).
LUNATE_LATIN = "ϲc ϹC"
#: Latin letters of phonetic notation that look like a usual one; left alone in a word with others of their kind.
PHONETIC = "ɑa ɡg"
#: Letters of the Arabic script that other languages use where Arabic has the second one.
ARABIC_VARIANTS = "یي ېي ۍي ےي کك ڪك ہه ەه ھه"
#: Han characters that look like a katakana letter, when katakana stand on both sides.
HAN_KATAKANA = "一ー 二ニ 八ハ 力カ 口ロ 夕タ 工エ 卜ト 千チ 才オ"
#: Letters that only Persian, Urdu and their neighbours use; with one of them present the variants above are usual.
PERSIAN_ONLY = set("پچژگٹڈڑں")


def _pairs(text: str) -> dict[str, str]:
    return {p[0]: p[1] for p in text.split()}


_TO_LATIN = [_pairs(p) for p in (CYRILLIC_LATIN, GREEK_LATIN, ARMENIAN_LATIN, COPTIC_LATIN, CHEROKEE_LATIN, LISU_LATIN, LUNATE_LATIN)]
_LOOK: dict[str, dict[str, str]] = {}  # letter -> script -> the letter of that script that looks like it
_SCRIPTS = {"LATIN": "Latn", "CYRILLIC": "Cyrl", "GREEK": "Grek", "ARMENIAN": "Armn", "COPTIC": "Copt", "CHEROKEE": "Cher", "LISU": "Lisu"}


@lru_cache(maxsize=8192)
def _script(ch: str) -> str:
    return _SCRIPTS.get(ud.name(ch, "").split(" ", 1)[0], "")


def _link(a: str, b: str) -> None:
    _LOOK.setdefault(a, {_script(a): a}).setdefault(_script(b), b)
    _LOOK.setdefault(b, {_script(b): b}).setdefault(_script(a), a)


for _x, _y in [pair for t in [*_TO_LATIN, _pairs(GREEK_CYRILLIC)] for pair in t.items()]:
    _link(_x, _y)
for _x, _y in _pairs(LUNATE_LATIN).items():
    _LOOK[_x].setdefault("Cyrl", _LOOK[_y]["Cyrl"])
_ARABIC = str.maketrans(_pairs(ARABIC_VARIANTS))
_KATAKANA = _pairs(HAN_KATAKANA)
_ORDER = tuple(_SCRIPTS.values())
_IN_SCRIPTS = r"\p{Latin}\p{Cyrillic}\p{Greek}\p{Armenian}\p{Coptic}\p{Cherokee}\p{Lisu}"
_TOKEN = regex.compile(rf"[{_IN_SCRIPTS}][{_IN_SCRIPTS}\p{{Mn}}]*")
#: One class for each script, as ranges: the standard module scans these faster than script properties.
_SCRIPT_RANGES = {
    "Latn": r"A-Za-z\u00c0-\u024f\u1e00-\u1eff", "Cyrl": r"\u0400-\u052f", "Grek": r"\u0370-\u03e1\u03f0-\u03ff\u1f00-\u1fff", "Armn": r"\u0531-\u0587",
    "Copt": r"\u03e2-\u03ef\u2c80-\u2cff", "Cher": r"\u13a0-\u13ff\uab70-\uabbf", "Lisu": r"\ua4d0-\ua4ff",
}
_OTHER_SCRIPT = re.compile(r"[\u0370-\u0587\u13a0-\u13ff\u1f00-\u1fff\u2c80-\u2cff\ua4d0-\ua4ff\uab70-\uabbf]")
_PHONETIC = str.maketrans(_pairs(PHONETIC))
_PHONETIC_LETTER = re.compile(f"[{''.join(_pairs(PHONETIC))}]")
_PHONETIC_WORD = re.compile(rf"[{_SCRIPT_RANGES['Latn']}\u0250-\u02ff]+")
_PHONETIC_SIGN = re.compile(r"[\u0250-\u02ff]")
_EACH_SCRIPT = [re.compile(f"[{r}]") for r in _SCRIPT_RANGES.values()]
#: Anything whose form may be unusual: unseen characters, spaces other than the usual, marks, compatibility letters.
_SUSPECT = re.compile(
    r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\xa0\xad\u0132\u0133\u01c4-\u01cc\u01f1-\u01f3\u0149\u017f\u0300-\u036f\u0483-\u0489\u0600-\u0605\u061c\u0653-\u0655\u06cc\u06a9\u06aa\u06c1\u06be\u06d0\u06cd\u06d2\u06d5\u06dd\u070f"
    r"\u0e4d\u115f\u1160\u1680\u180b-\u180e\u1ab0-\u1aff\u1dc0-\u1dff\u2000-\u200f\u2028-\u202f\u205f-\u206f\u20d0-\u20ff\u2100-\u214f\u2160-\u217f\u24b6-\u24e9\u2c7c\u2c7d\u2e80-\u2fdf\u3000\u3099\u309a\u3164"
    r"\uf900-\ufaff\ufb00-\ufdff\ufe00-\ufe0f\ufe20-\ufe2f\ufe70-\ufeff\uff10-\uff19\uff21-\uff3a\uff41-\uff5a\uff66-\uffdc\ufff0-\ufffb\U0001bca0-\U0001bca3\U0001d173-\U0001d17a\U0001d400-\U0001d7ff\U0002f800-\U0002fa1f\U000e0000-\U000e01ef]"
)
_BREAKS = {"\u2028": "\n", "\u2029": "\n"}
_HANGUL_FILLERS = set("\u115f\u1160\u3164\uffa0\u034f")
_VIRAMA = {chr(c) for c in range(0x0900, 0x0D80) if ud.combining(chr(c)) == 9}


def _plain_word(m: re.Match) -> str:
    """A Latin word with its phonetic letters as the usual ones, unless it holds other signs of phonetic notation or usual letters are none."""
    word = m.group()
    bare = word.translate(_PHONETIC)
    return word if _PHONETIC_SIGN.search(bare) or not _PHONETIC_LETTER.sub("", word) else bare


def _resolve_tokens(text: str) -> str:
    """Writes every token in the one script it can be spelled in; see the module's text."""
    if not _OTHER_SCRIPT.search(text) or sum(1 for r in _EACH_SCRIPT if r.search(text)) < 2:
        return text
    spans, own = [], []
    for m in _TOKEN.finditer(text):
        token = m.group()
        letters = [c for c in token if _script(c)]
        can = set(_ORDER)
        for c in letters:
            can &= set(_LOOK.get(c, {_script(c): c}))
        present = {_script(c) for c in letters}
        spans.append((m.start(), m.end(), token, can, present))
        own.append(next(iter(can)) if len(can) == 1 else (max(present, key=lambda s: sum(_script(c) == s for c in letters)) if not can else ""))
    if len({s for s in own if s}) <= 1 and not any(len(p[4]) > 1 for p in spans) and not any(o == "" for o in own):
        return text
    before, after = [*accumulate(own, lambda x, y: y or x)], [*accumulate(reversed(own), lambda x, y: y or x)][::-1]  # the nearest settled ones
    out, at = [], 0
    for i, (start, end, token, can, present) in enumerate(spans):
        target = own[i] if len(can) == 1 else ""
        if not target and can:
            left, right = before[i], after[i]
            near = left if left == right or not right else right if not left else ""
            if near and near in can:
                target = near
            elif len(present) > 1 and not near:
                target = sorted(present & can, key=_ORDER.index)[0] if present & can else sorted(can, key=_ORDER.index)[0]
            elif not near:
                target = ""
        if target and present != {target}:
            token = "".join(_LOOK.get(c, {}).get(target, c) for c in token)
        out += [text[at:start], token]
        at = end
    return "".join(out) + text[at:]


@lru_cache(maxsize=65536)
def _char(ch: str) -> str:
    """The usual form of one character standing alone."""
    kind = ud.category(ch)
    o = ord(ch)
    if ch in _BREAKS:
        return _BREAKS[ch]
    if kind == "Zs":
        return " "
    if kind == "Cf" or ch in _HANGUL_FILLERS or 0xFE00 <= o <= 0xFE0F or 0xE0100 <= o <= 0xE01EF:
        return ""
    if kind == "Cc":
        return ch if ch in "\t\n\r" else ""
    if 0x2E80 <= o <= 0x2FDF or 0xF900 <= o <= 0xFAFF or 0x2F800 <= o <= 0x2FA1F:
        return ud.normalize("NFKC", ch)
    if ch in "ªº" or ch == "\u0e33" or ch == "\u0eb3":
        return ch
    if kind == "Nl":
        form = ud.normalize("NFKC", ch)
        return form if form.isascii() else ch  # Roman numerals look like letters; other letter numbers are what they are
    if kind in ("Lu", "Ll", "Lt", "Lo", "Nd") or kind == "Lm" and 0xFF00 <= o or 0x24B6 <= o <= 0x24E9:
        form = ud.normalize("NFKC", ch)
        return form if form and ud.category(form[0])[0] in "LMN" else ch
    return ch


_DEVANAGARI_SAFE = regex.compile(r"[\u0900-\u0dff\u0e00-\u0eff]+")


def _nfc(text: str) -> str:
    """Letters and accents together; Indic, Thai and Lao spelling stays as it is usual."""
    if ud.is_normalized("NFC", text):
        return text
    out, at = [], 0
    for m in _DEVANAGARI_SAFE.finditer(text):
        out += [ud.normalize("NFC", text[at : m.start()]), m.group()]
        at = m.end()
    return "".join(out) + ud.normalize("NFC", text[at:])


def one_form(text: str | None) -> str | None:
    """The consistent form of a text: equal for texts that look the same. Null stays null, blank stays as it is."""
    if text is None or text.isascii() and text.isprintable():
        return text
    t = text
    if _SUSPECT.search(t):
        chars = []
        for i, ch in enumerate(t):
            if ch in "\u200c\u200d" and i and (t[i - 1] in _VIRAMA or ud.category(t[i - 1]) == "So"):
                chars.append(ch)  # joiners that shape Indic conjuncts and emoji
            elif ch == "\u3000" and _wide(t[i - 1 : i]) and _wide(t[i + 1 : i + 2]):
                chars.append(ch)  # the usual space between wide characters
            elif "\ufe00" <= ch <= "\ufe0f" and i and ud.category(t[i - 1]) == "So":
                chars.append(ch)
            else:
                chars.append(_char(ch) if ch > "\x7f" or ch < " " or ch == "\x7f" else ch)
        t = _nfc("".join(chars))
        t = regex.sub("\u0e4d([\u0e48-\u0e4b]?)\u0e32", "\\1\u0e33", t)
        if not PERSIAN_ONLY & set(t):
            t = t.translate(_ARABIC)
    t = t.replace("\u0e40\u0e40", "\u0e41")
    if t.isascii():
        return t
    if _PHONETIC_LETTER.search(t):
        t = _PHONETIC_WORD.sub(_plain_word, t)
    t = _resolve_tokens(t)
    if any(c in t for c in _KATAKANA):
        t = regex.sub("(?<=[ァ-ヺー])[一二八力口夕工卜千才](?=[ァ-ヺー])", lambda m: _KATAKANA[m.group()], t)
    return t


def _wide(ch: str) -> bool:
    return bool(ch) and ud.east_asian_width(ch) in "WF" and ch != "\u3000"


def is_case(text: str | None) -> bool:
    """Whether the text holds a character in an unusual form."""
    return text is not None and not (text.isascii() and text.isprintable()) and one_form(text) != text


_APART = regex.compile(r"[\p{P}\p{S}\p{Cc}\s]+")
_CASED_APART = regex.compile(r"[^\w]+", regex.ASCII)


#: Letters whose capital is several letters (ligatures, some Greek ones), but for the sharp s; they are another form, not another case, of these.
_SEVERAL = re.compile("[" + "".join(c for c in map(chr, range(0x80, 0x20000)) if c != "ß" and len(c.upper()) > 1) + "]")


def fold(text: str) -> str:
    """Letter case disregarded, in every script: upper first, so that sharp s and dotless i meet their capitals.

    Each character folds by itself, whatever stands around it; the capital sharp s alone stays a letter when it is lowered.
    """
    if text.isascii():
        return text.lower()
    if _SEVERAL.search(text):
        t = "".join(c.lower() if _SEVERAL.match(c) else c.upper().lower() for c in text)
    else:
        t = text.upper().lower()
    return t.replace("\u0307", "").replace("ς", "σ").replace("ß", "ss")


def words(text: str | None) -> list[str]:
    """What blanks and punctuation leave, case ignored; null or blank gives none."""
    if not text:
        return []
    t = fold(text)
    if t.isascii():
        return _CASED_APART.sub(" ", t.replace("_", " ")).split()
    return _APART.sub(" ", t).split()
