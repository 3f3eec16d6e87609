"""Sentence boundaries across languages and scripts, by cascading tables of break and no-break rules.

A text is first cut into blocks at blank lines; a list line is a unit by itself. In what remains, every end mark and every wide
gap is a candidate. What stands before it and what follows it go through rule tables in order; each rule is a pair of patterns,
and the first pair that matches decides. A rule may also send the candidate on to the next table.

Which tables make the cascade is told by the candidate's kind (after a quotation, after a mark without a gap, after a mark, a
wide gap), by the cases of the sentence's letters, and by the script of the character that the mark follows: a full stop after
Cyrillic goes through the tables for Cyrillic languages, and so on. Marks inside a quotation or brackets are no candidates.
Pairs of quotation marks and brackets are found in one pass over a block, whatever their length; patterns see the whole block.

Rows are independent: one pass over the documents in Arrow batches, no shuffle.

Defined results: null, empty and blank texts have no sentences; repeated rows give repeated rows; offsets count code points;
a quotation mark or bracket without a partner in its block is none; other columns are not read.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: ON leaves a table for the next one.
BREAK, STAY, ON = True, False, None


class Rule(NamedTuple):
    decision: bool | None
    before: regex.Pattern | None
    after: regex.Pattern | None
    whole: bool = False


def _rule(decision: bool | None, before: str = "", after: str = "", flags: int = 0, whole: bool = False) -> Rule:
    """before ends at the candidate (its gap left out), after starts with what follows the gap; "" matches anything.
    whole: before is all that the sentence has so far."""
    return Rule(decision, regex.compile(f"(?:{before})", flags | (0 if whole else regex.REVERSE)) if before else None, regex.compile(after, flags) if after else None, whole)


def _words(*names: str) -> str:
    return r"(?<![\p{L}\p{M}\d])(?:" + "|".join(n.replace(".", r"\.").replace(" ", r"\s?") for n in sorted(names, key=len, reverse=True)) + r")\."


I = regex.IGNORECASE  # noqa: E741
_MARK = regex.compile(r"[.!?…。！？।॥؟｡．]+")
_NUMBER = r"(?=\d|[IVXLC]+\b|[A-Z]\.?\d)"

# ---- Fixed values: abbreviations by language --------------------------------------------------------------------------
VI_TITLES = ("TS", "ThS", "PGS", "GS", "PGS.TS", "GS.TS", "KS", "LS", "BS", "CN", "TP", "TX", "Cty", "UBND X", "P", "Q", "X", "H", "TT")
EN_TITLES = ("Mr", "Mrs", "Ms", "Dr", "Prof", "Messrs", "Rev", "Hon", "Gen", "Capt", "approx", "cf", "i.e", "e.g", "vs", "viz", "incl", "sq", "Bldg", "Apt")
EN_NUMBERED = ("No", "Nos", "Art", "Arts", "Sec", "Secs", "Fig", "Figs", "p", "pp", "Ch", "Vol", "Par", "para", "App", "Reg")
EN_MONTHS = ("Jan", "Feb", "Mar", "Apr", "Jun", "Jul", "Aug", "Sep", "Sept", "Oct", "Nov", "Dec")
EN_OPEN_ENDED = ("Co", "Corp", "Inc", "Ltd", "etc", "a.m", "p.m", "U.S", "U.K", "Ave", "Blvd", "Rd", "Jr", "Sr")
DE_STAY = ("Hr", "Fr", "Hrn", "Dr", "Prof", "Dipl.-Ing", "Ing", "bzw", "z. B", "z.B", "ca", "Gem", "gem", "vgl", "u. a", "d. h", "i. d. R", "ggf", "inkl", "zzgl", "geb", "St")
DE_NUMBERED = ("Nr", "Abs", "Art", "S", "Bd", "Ziff", "Kap", "Abb", "Tel", "Rn", "Bl")
DE_MONTHS = r"(?:Januar|Jänner|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember|Jan|Feb|Mrz|Apr|Jun|Jul|Aug|Sept?|Okt|Nov|Dez)\b"
FR_STAY = ("M", "MM", "Mme", "Mmes", "Mlle", "Me", "Dr", "Pr", "cf", "env", "av", "bd", "St", "Ste", "boul")
FR_NUMBERED = ("art", "p", "pp", "n", "al", "chap", "fig", "vol", "éd")
FR_MONTHS = ("janv", "févr", "fév", "avr", "juil", "sept", "oct", "nov", "déc")
RU_STAY = ("ул", "пр", "пер", "пл", "корп", "стр", "кв", "см", "инж", "проф", "доц", "акад", "им", "гор", "обл", "р-н", "т. е", "т.е", "т. к", "напр", "ср", "тыс", "млн", "млрд", "д-р")
RU_NUMBERED = ("д", "п", "пп", "ст", "гл", "рис", "табл", "стр", "с", "л", "янв", "февр", "фев", "мар", "апр", "июн", "июл", "авг", "сент", "сен", "окт", "нояб", "ноя", "дек")
RU_PERSON = r"(?:инж\.|проф\.|г-н|г-жа|д-р|доц\.|акад\.)\s"
# ---- end of fixed values ------------------------------------------------------------------------------------------------

_C = r"[”»」』’)\]\"]*"  # closers after a mark

TABLES: dict[str, list[Rule]] = {
    "continued": [_rule(STAY, "", r"[.…,;:]")],
    "heading": [
        _rule(STAY, r"(?:\d{1,3}(?:\.\d{1,3})*|[IVXLCDM]{1,7}|\p{Lu})\.", whole=True),
        _rule(STAY, r"(?:Part|Section|Chapter|Annex|Phần|Chương|Mục|Phụ lục|Điều|Teil|Abschnitt|Kapitel|Anlage|Partie|Chapitre|Annexe|Titre|Часть|Глава|Раздел|भाग|अध्याय|ส่วนที่|บทที่)\s+(?:\d{1,3}|[IVXLCDM]{1,7}|\p{Lu})\.", "", I, whole=True),
    ],
    "ellipsis": [_rule(STAY, rf"(?:…|\.{{2,}}){_C}")],
    "ellipsis after small letters": [_rule(BREAK, rf"(?:…|\.{{2,}}){_C}", r"\p{Lu}")],
    "exclamation": [_rule(BREAK, r"[!?！？؟。।॥｡][\"”»」』’)\]\s]*")],
    "vi": [
        _rule(STAY, _words(*VI_TITLES), r"(?=[\p{L}\d])"),
        _rule(STAY, r"(?<![\p{L}\d])Đ\.", r"(?=\d)"),
        _rule(STAY, r"(?<![\p{L}\d])đ\.", r"(?=\d+\s*k\.)"),
        _rule(STAY, r"(?<![\p{L}\d])k\.", r"(?=\d)"),
        _rule(STAY, _words("ts", "ths", "pgs", "gs", "pgs.ts", "gs.ts", "ks", "ls", "bs", "tp", "tx", "cty", "p", "q", "x"), r"(?=[\p{Ll}\d])"),
        _rule(BREAK, _words("v.v"), r"[^,;\p{Ll}]"),
    ],
    "en": [
        _rule(STAY, _words(*EN_TITLES), "", I),
        _rule(STAY, _words(*EN_NUMBERED), _NUMBER, I),
        _rule(STAY, _words(*EN_MONTHS), r"(?=\d)", I),
        _rule(STAY, r"(?<!\p{Lu}[\p{L}\-’']{1,30}\s)\bSt\.", r"(?=\p{Lu})"),
        _rule(STAY, r"(?<![\p{L}\d])sq\.\s?m\.", r"(?=\p{Ll})"),
        _rule(STAY, _words(*EN_OPEN_ENDED), r"(?=[(,;&])", I),
    ],
    "de": [
        _rule(STAY, _words(*DE_STAY)),
        _rule(STAY, r"(?<![\p{L}\d])\p{Ll}\.", r"(?=\p{L}\.)"),
        _rule(STAY, _words("hr", "dipl.-ing", "bzw", "gem", "z. b", "z.b", "ca", "vgl")),
        _rule(STAY, _words(*DE_NUMBERED), r"(?=\d)", I),
    ],
    "ordinals": [
        _rule(STAY, r"(?<![\d.,/])\d{1,2}\.", rf"(?={DE_MONTHS}|(?:Stock|Stockwerk|OG|Etage|Quartal|Halbjahr|Jahrhundert|Jh|Klasse|Mai|Auflage|Zivilsenat|Senat|Kammer)\b)", I),
    ],
    "fr": [
        _rule(STAY, _words(*FR_STAY), r"(?=[\p{L}\d])"),
        _rule(STAY, _words("mme", "mlle", "cf")),
        _rule(STAY, _words(*FR_NUMBERED), r"(?=\d)", I),
        _rule(STAY, _words(*FR_MONTHS), r"(?=\d)", I),
    ],
    "ru": [
        _rule(STAY, _words(*RU_STAY), "", I),
        _rule(STAY, _words(*RU_NUMBERED), r"(?=\d)", I),
    ],
    "persons": [
        _rule(BREAK, r"[\p{Cyrillic}\d%]\.", rf"(?={RU_PERSON})"),
    ],
    "ar": [_rule(STAY, r"(?<![\p{Arabic}\p{M}])\p{Arabic}\.", r"(?=\p{Arabic})")],
    "hi": [_rule(STAY, r"[\p{Devanagari}]\.")],
    "th": [_rule(STAY, r"[\p{Thai}]\.", r"(?=[\p{Thai}\d])")],
    "initials": [_rule(STAY, r"(?<![\p{L}\p{M}\d/.])\p{Lu}\.", r"(?=\p{Lu})"), _rule(STAY, r"(?<=\p{Lu}\.\s?)\p{Lu}\.", r"(?=\p{Lu}\p{Ll})")],
    "general": [
        _rule(BREAK, "", r"[\p{Lu}\p{Lt}]"),
        _rule(BREAK, "", r"[“„«「『\"‘¿¡(\[№§\p{Lo}\d•]"),
        _rule(STAY, "", r"[,;:\)\]–—\-\p{Ll}]"),
        _rule(BREAK),
    ],
    # After a quotation that closes with an end mark.
    "quotation goes on": [_rule(STAY, "", r"[,;:、，；：–—\-).]")],
    "quotation, mixed case": [_rule(BREAK, "", r"\p{Lu}"), _rule(STAY, "", r"\p{Ll}")],
    "quotation, small letters": [_rule(BREAK, "", r"\p{Lu}")],
    "quotation first": [_rule(BREAK, "", r"[\p{Lu}\p{Ll}]"), _rule(STAY, "", r"と|って|という|など"), _rule(BREAK, "", r"\p{L}")],
    "quotation within": [_rule(STAY, "", r"\p{L}")],
    "quotation end": [_rule(BREAK)],
    # After a mark without a gap.
    "glued": [_rule(BREAK, rf"(?:[。！？｡।॥؟]|。\p{{P}}*){_C}"), _rule(BREAK, rf"[!?]{_C}", r"(?![\p{Lu}\p{Ll}])\p{L}")],
    "address": [_rule(STAY)],
    "glued prose": [
        _rule(BREAK, rf"[!?]{_C}", r"\p{Lu}"),
        _rule(STAY, rf"[!?]{_C}", r"\p{L}"),
        _rule(STAY, r"\d\."),
        _rule(ON, r"(?:\p{Ll}{2}|[)%²³\"”]|\d)[.!?]", r"\p{Lu}\p{L}*[\s\p{Ll}]"),
        _rule(STAY),
    ],
    # A wide gap.
    "gap after Thai": [_rule(BREAK)],
    "gap": [_rule(STAY)],
}
#: Where a sentence has letters of one case only, case tells of no new sentence: abbreviations of all languages, in any case.
TABLES["one case"] = [
    _rule(ON, "", r"[^\p{Lu}\p{Ll}]"),
    *TABLES["heading"],
    _rule(STAY, _words(*VI_TITLES, *EN_TITLES, *DE_STAY, *FR_STAY, *RU_STAY), "", I),
    _rule(STAY, _words(*EN_NUMBERED, *DE_NUMBERED, *FR_NUMBERED, *RU_NUMBERED, *EN_MONTHS, *FR_MONTHS, "k"), _NUMBER, I),
    _rule(STAY, _words(*[x for x in EN_OPEN_ENDED if x not in ("Ltd", "etc", "Inc", "Corp")]), "", I),
    _rule(STAY, r"(?<![\p{L}\d])đ\.", r"(?=\d+\s*k\.)", I),
    _rule(STAY, r"(?<![\p{L}\d])đ\.(?<!\d\s?đ\.)", "", I),
    _rule(BREAK, r"(?<=\d)\s?đ\.", "", I),
    _rule(BREAK, r"(?:[/²])\p{L}\.|\p{L}[²³]\.", ""),
    _rule(BREAK, r"(?<![\p{L}\d])sq\.\s?m\.", "", I),
    _rule(STAY, r"(?<![\p{L}\p{M}\d/.])\p{L}\.", r"(?=\p{L})"),
    *TABLES["ordinals"],
]
TABLES |= {
    "one case, small": [_rule(BREAK, "", r"\p{Ll}")],
    "one case, capital": [_rule(BREAK, "", r"\p{Lu}")],
    "one case, no letters": [_rule(STAY, "", r"\p{Ll}")],
}

#: The tables of a full stop by the script of the character before it.
BY_SCRIPT = {
    "Latin": ("vi", "en", "de", "fr", "initials"),
    "Cyrillic": ("ru", "persons", "initials"),
    "Arabic": ("ar",),
    "Devanagari": ("hi",),
    "Thai": ("th",),
    "number": ("ordinals", "persons"),
    "other": ("vi", "en", "de", "ordinals", "fr", "ru", "persons", "ar", "hi", "th", "initials"),
    "plain word": (),
}
_CLASSES = [(k, regex.compile(p)) for k, p in (("number", r"[0-9%²³€)]"), *[(s, rf"\p{{{s}}}") for s in ("Latin", "Cyrillic", "Arabic", "Devanagari", "Thai")])]
#: The abbreviations' last words. Another Latin word of two letters or more is plain: no abbreviation's table says anything of it.
_KNOWN = {x.lower().replace(" ", "").rpartition(".")[2].rpartition("-")[2] for n in (VI_TITLES, EN_TITLES, EN_NUMBERED, EN_MONTHS, EN_OPEN_ENDED, DE_STAY, DE_NUMBERED, FR_STAY, FR_NUMBERED, FR_MONTHS) for x in n} | {"x", "v"}
_PLAIN_WORD = regex.compile(r"(?<![\p{L}\p{M}\d.\-])\p{Latin}[\p{Latin}\p{M}]+\.", regex.REVERSE)


@lru_cache(1 << 14)
def _script(c: str) -> str:
    return next((k for k, p in _CLASSES if p.match(c)), "other")


@lru_cache(1 << 10)
def cascade(kind: str, case: str = "", mark: str = "", script: str = "") -> tuple[list[Rule], ...]:
    """The tables for a candidate.

    kind: quotation first, quotation within, glued, address, gap (after a mark), wide, wide after Thai. case: of the sentence's letters,
    mixed, small, capital or none. mark: "." a full stop alone, ".)" with closers, "…", "!" others. script: of the character before ".".
    """
    if kind.startswith("quotation"):
        own = {"mixed": ("quotation, mixed case",), "small": ("quotation, small letters",)}.get(case, ())
        names: tuple[str, ...] = ("quotation goes on", *own, kind, "quotation end")
    elif kind.startswith("wide"):
        names = ("gap after Thai",) if kind == "wide after Thai" else ("gap",)
    else:
        names = {"glued": ("glued", "glued prose"), "address": ("glued", "address")}.get(kind, ())
        if kind == "gap" and mark == "." and case != "mixed":
            names += ("one case", {"small": "one case, small", "capital": "one case, capital"}.get(case, "one case, no letters"))
        names += ("continued",)
        if mark == ".":
            names += ("heading", *BY_SCRIPT[script])
        elif mark == "…":
            names += ("ellipsis after small letters", "ellipsis") if case in ("mixed", "small") else ("ellipsis",)
        elif mark == "!":
            names += ("exclamation",)
        names += ("general",)
    return tuple(TABLES[n] for n in names)


def decided(tables: tuple[list[Rule], ...], text: str, first: int, end: int, after: int) -> bool:
    """What the tables say of a candidate: its sentence begins at ``first``, ends at ``end``, and ``after`` is what follows the gap."""
    for rules in tables:
        for r in rules:
            p = r.before
            if (p is None or (p.fullmatch(text, first, end) if r.whole else p.match(text, first, end))) and (r.after is None or r.after.match(text, after)):
                if r.decision is None:
                    break
                return r.decision
    return STAY


_BULLET = regex.compile(r"[^\S\n]*[•●▪◦‣*·–\-][^\S\n]+\S")
_NUMBERED = regex.compile(r"[^\S\n]*\(?(?:\d{1,3}[.)]|[a-zđ]\))\s+\S")
_BLANK = regex.compile(r"(?:\r\n?|[\n\u2028\u2029\x0b\x0c\x85])(?:[^\S\r\n]*(?:\r\n?|[\n\u2028\u2029\x0b\x0c\x85]))+")
_LINE = regex.compile(r"[^\r\n\u2028\u2029\x0b\x0c\x85]+")
_WIDE_GAP = regex.compile(r"\s*[\n\u2028]\s*|\s{2,}")
_LETTER, _LAST_LETTER = regex.compile(r"\p{L}"), regex.compile(r"\p{L}", regex.REVERSE)
_UPPER, _LOWER = regex.compile(r"\p{Lu}"), regex.compile(r"\p{Ll}")
_THAI = regex.compile(r"[\p{Thai}]")
_ADDRESS = regex.compile(r"(?:://|www\.)\S*")
_INK, _LAST_INK = regex.compile(r"\S"), regex.compile(r"\S", regex.REVERSE)

_PAIRED = regex.compile(r"[“”„«»「」『』‚‹›‘\"()\[\]（）]")
_BRACKETS = {"(": ")", "[": "]", "（": "）"}
_OPENS = {"»": "«", "」": "「", "』": "『", "›": "‹", "‘": "‚"} | {z: a for a, z in _BRACKETS.items()}
_CLOSERS = "”»」』’)]\""


def quotations(text: str) -> list[tuple[int, int, bool]]:
    """(start, end, is quotation) of outermost quotations and brackets, of any length, in one pass. What is not closed is no pair.

    “ closes a „ that is open, else it opens; a straight mark opens after a gap and closes where none stands before it.
    """
    if not _PAIRED.search(text):
        return []
    partner: dict[int, int] = {}
    open_: dict[str, list[int]] = {c: [] for c in "“„«「『‚‹([（"}
    straight: list[int] = []  # straight marks that wait for the next that may close
    for m in _PAIRED.finditer(text):
        i, c = m.start(), m[0]
        if c == '"':
            if straight and i and not text[i - 1].isspace():
                for k in straight:
                    partner[k] = i
                straight = []
            if (i == 0 or text[i - 1].isspace() or text[i - 1] in "([—–-：:/") and i + 1 < len(text) and not text[i + 1].isspace():
                straight.append(i)
            continue
        if c in "“”":
            low, high = open_["„"], open_["“"]
            if low and (not high or low[-1] > high[-1] or c == "”" and not high):
                partner[low.pop()] = i
            elif c == "”":
                if high:
                    partner[high.pop()] = i
            else:
                high.append(i)
        elif c in open_:
            open_[c].append(i)
        elif open_[_OPENS[c]]:
            partner[open_[_OPENS[c]].pop()] = i
    out, at = [], 0
    for i in sorted(partner):
        if i >= at:
            at = partner[i] + 1
            out.append((i, at, text[i] not in _BRACKETS))
    return out


def _unit(text: str, spans: list[tuple[int, int, bool]]) -> list[int]:
    """The places in a unit (composed) where one sentence ends and the next may begin."""
    cuts, start, s, n = [], 0, 0, len(text)
    candidates = [(m.start(), m.end(), True) for m in _MARK.finditer(text)]
    thai = _THAI.search(text) is not None
    if thai:
        candidates = sorted(candidates + [(m.start(), m.start(), False) for m in _WIDE_GAP.finditer(text)], key=lambda x: (x[1], x[2]))
    addresses = [m.span() for m in _ADDRESS.finditer(text)] if "://" in text or "www." in text else []
    address, first = 0, -1
    # What is known of the sentence so far; each part of it is looked at once.
    seen, upper, lower, after_thai = 0, False, False, False
    ink_end = -1  # where the ink of the quotation at s ends before its closing mark
    for a, e, mark in candidates:
        if e < start:
            continue
        while s < len(spans) and spans[s][1] <= a:
            s, ink_end = s + 1, -1
        quote, end = None, e
        if s < len(spans) and spans[s][0] < a:
            x, z, is_quote = spans[s]
            if not is_quote or not mark:
                continue
            if ink_end < 0:
                ink_end = m.end() if (m := _LAST_INK.search(text, x, z - 1)) else x
            if e < ink_end:
                continue
            quote, e = x, z
        if mark:
            while quote is None and e < n and text[e] in _CLOSERS:  # closers without a partner
                if text[e] == '"' and any(b == e for b, _, _ in spans[s : s + 2]):
                    break
                e += 1
            while quote is not None and e < n and text[e] in _CLOSERS:
                if text[e] == '"' and any(b == e for b, _, _ in spans[s : s + 2]):
                    break
                e += 1
        gap = e
        while gap < n and text[gap].isspace():
            gap += 1
        if mark and gap >= n:
            break
        if seen < e:
            upper = upper or _UPPER.search(text, seen, e) is not None
            lower = lower or _LOWER.search(text, seen, e) is not None
            if thai:
                if (m := _LAST_LETTER.search(text, seen, e)) is not None:
                    after_thai = _THAI.match(m[0]) is not None
            seen = e
        if first < start:
            first = m.start() if (m := _INK.search(text, start)) else n
        case = ("mixed" if lower else "capital") if upper else "small" if lower else "none"
        if not mark:
            last_ink = _LAST_INK.search(text, start, e)
            tables = cascade("wide after Thai" if last_ink is not None and (after_thai or _THAI.match(last_ink[0])) else "wide")
        elif quote is not None:
            tables = cascade("quotation first" if quote <= first else "quotation within", case)
        else:
            if a + 1 == end:
                kind = text[a] if text[a] in ".…" else "!"
                kind = ".)" if kind == "." and e > end else kind
            elif not text[a:end].strip(".…"):
                kind = "…"
            else:
                kind = "!" if text[end - 1] != "." else "."
            script = ""
            if kind == ".":
                script = _script(text[a - 1]) if a else "other"
                if script == "Latin" and (m := _PLAIN_WORD.match(text, first, e)) is not None and m[0][:-1].lower() not in _KNOWN:
                    script = "plain word"
            if gap > e:
                tables = cascade("gap", case, kind, script)
            else:
                while address < len(addresses) and addresses[address][1] < e:
                    address += 1
                inside = address < len(addresses) and addresses[address][0] < e
                tables = cascade("address" if inside else "glued", case, kind, script)
        if decided(tables, text, first, e, gap):
            cuts.append(e)
            start, upper, lower, after_thai = e, False, False, False
    return cuts


def _composed(text: str) -> tuple[str, list[int] | None]:
    """The text composed, and of each place in it the place it has in the text (None: the same)."""
    if unicodedata.is_normalized("NFC", text):
        return text, None
    out, at = [], []
    for m in regex.finditer(r"\X", text):
        y = unicodedata.normalize("NFC", m[0])
        out.append(y)
        at += [m.start()] * len(y)
    return "".join(out), [*at, len(text)]


def sentences(text: str | None) -> list[tuple[int, int]]:
    """(start, end) of every sentence, in code points, end exclusive."""
    out: list[tuple[int, int]] = []

    def add(a: int, z: int) -> None:
        while a < z and text[a].isspace():
            a += 1
        while z > a and text[z - 1].isspace():
            z -= 1
        if a < z:
            out.append((a, z))

    def segment(a: int, z: int) -> None:
        body, places = _composed(text[a:z])
        at = a
        for c in _unit(body, quotations(body)):
            c = a + (c if places is None else places[c])
            add(at, c)
            at = c
        add(at, z)

    if not text:
        return out
    edges = [0, *[x for m in _BLANK.finditer(text) for x in (m.start(), m.end())], len(text)]
    for a, z in zip(edges[::2], edges[1::2], strict=True):
        at, listed = a, True
        for m in _LINE.finditer(text, a, z):
            line = m[0]
            if line.isspace():
                continue
            if _BULLET.match(line) or listed and _NUMBERED.match(line):
                segment(at, m.start())
                add(m.start(), m.end())
                at, listed = m.end(), True
            else:
                listed = False
        segment(at, z)
    return out


def sentence_units(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start_char, end_char of every sentence of every document."""
    kind = documents.schema[id_col].dataType.simpleString()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, starts, ends = [], [], []
            for k, t in enumerate(b.column(1).to_pylist()):
                for x, z in sentences(t):
                    at.append(k)
                    starts.append(x)
                    ends.append(z)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], [id_col, "start_char", "end_char"])

    return documents.select(id_col, text_col).mapInArrow(split, f"`{id_col}` {kind}, start_char int, end_char int")
