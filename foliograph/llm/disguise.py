"""Visually identical text with different characters, by script-aware repair.

Each character that has another form with the same looks goes to its ordinary one: wide, sans-serif and ligature forms, blanks,
characters that show nothing, accents apart from their letters. Letters of another alphabet are changed with care: a token's
dominant script is found, and look-alikes are put in its place only where the token mixes scripts and the result
is in the corpus vocabulary.

The vocabulary of glyph lines is every single-script word of the corpus. It is joined, not sent: tasks emit their distinct
words and the few repaired candidates, and a semi-join keeps what both hold. For texts that are compared with a list of terms,
the list's own words are the vocabulary and the repaired text meets the terms in an equi-join.

Defined results: a null or empty text is no case; ties between scripts try Latin first; repeated rows give repeated
rows (``p2_found`` is distinct); a case needs a row id; other columns are not read.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache, partial, reduce

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliograph.llm.blocks import bounded_blocks
from foliograph.llm.encoding import damaged_spans, legacy_line
from foliograph.llm.glyphstream import CHUNK, PAD, Lines, by_lines, whole_groups, with_open

# ---- Fixed values: letters with the looks of Latin ones ------------------------------------------------------------------
CYRILLIC = "АВЕЅІЈКМНОРСТУХаеоѕіјрсухһԁԛԝѵҮүӏԌꙅ"
CYRILLIC_LATIN = "ABESIJKMHOPCTYXaeosijpcyxhdqwvYylGs"
GREEK = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονϲϳ"
GREEK_LATIN = "ABEZHIKMNOPTYXovcj"
OTHER = "օսհոԼՕՏɡɑƉÐꞬ"
OTHER_LATIN = "ouhnLOSgaĐĐG"
# ---- end of fixed values ---------------------------------------------------------------------------------------------------

LATIN_OF = dict(zip(CYRILLIC + GREEK + OTHER, CYRILLIC_LATIN + GREEK_LATIN + OTHER_LATIN, strict=True))
CYRILLIC_OF = dict(zip(CYRILLIC_LATIN, CYRILLIC, strict=True)) | {"Y": "У", "y": "у", "s": "ѕ", "G": "Ԍ"}
GREEK_OF = dict(zip(GREEK_LATIN, GREEK, strict=True))
#: In Vietnamese and other Latin words the eth is no letter of the language; elsewhere it may be.
LATIN_FOREIGN = frozenset(OTHER) - frozenset("օսհոԼՕՏ")

NOTHING = r"\p{Cf}͏ᅟᅠ឴឵᠋-᠏ㅤﾠ︀-️\U000e0100-\U000e01ef"
_NOTHING = regex.compile(f"[{NOTHING}]")
_BLANK = regex.compile(r"[\p{Zs}--\ ]|[\t\u0085  ]", regex.V1)
_ACCENT = regex.compile(r"[̀-ͯ᪰-᫿᷀-᷿⃐-⃰]")
_WIDE_SCRIPT = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}\p{Bopomofo}]")
_WORD = regex.compile(r"[\p{L}\p{M}]+")
_SCRIPTS = {"latin": regex.compile(r"\p{Latin}"), "cyrillic": regex.compile(r"\p{Cyrillic}"), "greek": regex.compile(r"\p{Greek}"), "armenian": regex.compile(r"\p{Armenian}")}
#: A line without any of these needs no closer look.
_SUSPECT = regex.compile(rf"[{NOTHING}\p{{Cyrillic}}\p{{Greek}}\p{{Armenian}}̀-ͯ̀́᪰-᫿᷀-᷿⃐-⃰   -   　\t\u0085  ！-～￠-￦Ⅰ-ⅿﬀ-ﬆ\U0001d400-\U0001d7ffKÅɡɑƉÐꞬ]")


@lru_cache(1 << 16)
def ordinary(c: str) -> str:
    """The ordinary form of one code point, without a change of alphabet: "" for what shows nothing, a space for a blank."""
    if c < "\x7f" and c != "\t":
        return c
    if _NOTHING.match(c):
        return ""
    if _BLANK.match(c):
        return " "
    d = unicodedata.decomposition(c)
    if d.startswith(("<wide>", "<narrow>", "<font>")) or "Ⅰ" <= c <= "ⅿ" or "ﬀ" <= c <= "ﬆ":
        return unicodedata.normalize("NFKC", c)
    return c


def plain(text: str) -> str:
    """The text in ordinary characters, its alphabets unchanged."""
    return unicodedata.normalize("NFC", "".join(map(ordinary, text)))


def _swap(token: str, table: dict[str, str]) -> str:
    return unicodedata.normalize("NFC", "".join(table.get(c, c) for c in unicodedata.normalize("NFD", token))) if not token.isascii() or table is not LATIN_OF else token


def scripts(token: str) -> dict[str, int]:
    return {s: n for s, p in _SCRIPTS.items() if (n := len(p.findall(token)))}


def repairs(token: str) -> list[str]:
    """What a token of mixed scripts may stand for, the dominant script's reading first; nothing for other tokens."""
    found = scripts(token)
    foreign = any(c in LATIN_FOREIGN for c in token)
    if len(found) < 2 and not foreign:
        return []
    out = []
    for s in sorted(found, key=lambda s: (-found[s], s != "latin")):
        y = _swap(token, {"latin": LATIN_OF, "cyrillic": CYRILLIC_OF, "greek": GREEK_OF}.get(s, {}))
        if y != token and len(scripts(y)) == 1 and y not in out:
            out.append(y)
    return out


def repaired(text: str, vocabulary: frozenset[str]) -> str:
    """The text in ordinary characters with look-alikes replaced in tokens whose reading is in the vocabulary.

    Against a list of terms a token wholly in look-alikes counts as mixed: the text around it is in the terms' alphabet.
    """
    text = plain(text)

    def one(m: regex.Match) -> str:
        t = m[0]
        if t in vocabulary:
            return t
        for y in [*repairs(t), _swap(t, LATIN_OF)]:
            if y in vocabulary:
                return y
        return t

    return _WORD.sub(one, text)


def words_of(texts: Iterable[str]) -> frozenset[str]:
    return frozenset(w for t in texts for w in _WORD.findall(t))


#: Texts of these characters only are in their ordinary form already.
PLAIN_TEXT = r"^[ -~¡-¬®-ÏÑ-ƈƊ-ɏḀ-ỿ‐-‧‰-⁞₠-₿]*$"


def term_cases(texts: DataFrame, terms: DataFrame, term_chars: int = 50_000_000) -> DataFrame:
    """source_field, row_id, term_id of texts (source_field, row_id, text) that look like a term (term_id, term) but differ.

    The words of the terms go to the tasks, in blocks of at most ``term_chars`` characters (or one term), as many passes as that takes.
    """
    terms = terms.filter(F.col("term").isNotNull()).select("term_id", "term").distinct()
    odd = texts.filter(F.col("text").isNotNull() & ~F.col("text").rlike(PLAIN_TEXT)).select("source_field", "row_id", "text")
    return reduce(DataFrame.unionByName, [_term_pass(odd, block) for block in bounded_blocks(terms, ["term_id", "term"], "term", term_chars)])


def _term_pass(odd: DataFrame, terms: DataFrame) -> DataFrame:
    vocabulary = words_of(plain(r.term) for r in terms.select("term").collect())

    def repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = lru_cache(1 << 16)(lambda t: repaired(t, vocabulary))
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([known(t) for t in b.column(2).to_pylist()], pa.string())], [*b.schema.names, "term"])

    fixed = odd.mapInArrow(repair, "source_field string, row_id long, text string, term string")
    return fixed.filter("term <> text").join(terms, "term").select("source_field", "row_id", "term_id")


_OUT = "hit boolean, seq long, word string"


def _glyph_kernel(chunk: int, gap: int, pad: int):
    def cases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, ["doc_id", "page", "chunk"]):
            lines = Lines(t, chunk, pad, gap)
            hits, seqs, named = [], [], []
            vocabulary: set[str] = set()
            ch, again, home, seq = lines.ch, lines.again, lines.home, lines.seq
            for a, z, whole in zip(lines.start.tolist(), lines.end.tolist(), lines.whole.tolist(), strict=True):
                text = "".join([c for c in ch[a:z] if c])
                if not text or not whole or not home[a:z].any():
                    continue
                if not _SUSPECT.search(text):
                    vocabulary.update(_WORD.findall("".join([ch[i] for i in range(a, z) if ch[i] and not again[i]])))
                    continue
                for kind, i, word in _line_cases(ch, again, a, z):
                    if kind is None:
                        vocabulary.add(word)
                    elif home[i]:
                        hits.append(kind)
                        seqs.append(int(seq[i]))
                        named.append(word)
            n = len(vocabulary)
            yield with_open([pa.array(hits + [None] * n, pa.bool_()), pa.array(seqs + [None] * n, pa.int64()), pa.array(named + sorted(vocabulary), pa.string())], ["hit", "seq", "word"], lines)

    return cases


def _line_cases(ch: list[str | None], again, a: int, z: int) -> Iterator[tuple[bool | None, int, str | None]]:
    """(True, row, None): a case by itself; (False, row, word): a case if the word is in the vocabulary; (None, 0, word): a word of it."""
    drawn = [i for i in range(a, z) if ch[i] and not again[i]]
    text = "".join(ch[i] for i in drawn)
    at = [i for i in drawn for _ in ch[i]]  # the row of each code point
    wrong = [False] * len(text)
    if legacy_line(text):
        wrong = [c > "\x7f" for c in text]
    else:
        for x, y in damaged_spans(text):
            wrong[x:y] = [True] * (y - x)
    again_of: dict[int, list[int]] = {}
    first = a
    for i in range(a, z):
        if not again[i]:
            first = i
        again_of.setdefault(first, []).append(i)
    wide = _WIDE_SCRIPT.search(text) is not None
    latin1 = not any(c > "\xff" for c in text) and regex.search(r"[À-ÿ]", text) is not None
    clean, rows = [], []  # the ordinary text and the rows behind its code points
    for k, c in enumerate(text):
        if wrong[k]:
            clean.append("�")
            rows.append(k)
            continue
        i = at[k]
        y = ordinary(c)
        several = len(ch[i]) > 1
        own = not several and (y != c or _ACCENT.match(c) is not None or unicodedata.normalize("NFC", c) != c) and not (wide and (y == " " and c == "　" or "！" <= c <= "～"))
        if own or several and unicodedata.normalize("NFC", "".join(map(ordinary, ch[i]))) != ch[i] and (k == 0 or at[k - 1] != i):
            if c == "\xad" and latin1:
                # A soft hyphen among letters of one byte may be a letter of an old encoding: the word without it decides.
                x, w = k, k
                while x and (text[x - 1].isalpha() or text[x - 1] == "\xad"):
                    x -= 1
                while w < len(text) and (text[w].isalpha() or text[w] == "\xad"):
                    w += 1
                word = text[x:w].replace("\xad", "")
                for r in again_of[i]:
                    yield (False, r, word) if word else (True, r, None)
            else:
                for r in again_of[i]:
                    yield True, r, None
        for d in y:
            clean.append(d)
            rows.append(k)
    joined = "".join(clean)
    for m in _WORD.finditer(joined):
        word = unicodedata.normalize("NFC", m[0])
        options = repairs(word)
        if not options:
            if len(scripts(word)) < 2 and "�" not in joined[max(0, m.start() - 1) : m.end() + 1]:
                yield None, 0, word
            continue
        for y in options:
            target = {"latin": LATIN_OF, "cyrillic": CYRILLIC_OF, "greek": GREEK_OF}.get(next(iter(scripts(y))), {})
            for p in range(m.start(), m.end()):
                base = unicodedata.normalize("NFD", joined[p])[0]
                if joined[p] in target or base in target:
                    for r in again_of[at[rows[p]]]:
                        yield False, r, y


def glyph_cases(glyphs: DataFrame, chunk: int = CHUNK, pad: int = PAD) -> DataFrame:
    """seq of every glyph row whose ch isn't the ordinary character it shows."""
    found = by_lines(glyphs, ["ch", "x0", "top", "size"], partial(_glyph_kernel, chunk, pad), _OUT, chunk, pad)
    vocabulary = found.filter("hit IS NULL").select("word").distinct()
    return found.filter("hit").select("seq").unionByName(found.filter("NOT hit").join(vocabulary, "word", "left_semi").select("seq"))


def visual_cases(claims: DataFrame, terms: DataFrame, glyphs: DataFrame) -> DataFrame:
    """source_field, row_id, term_id: disguised claims with the term they show, and disguised glyphs with term 0."""
    texts = claims.select(F.col("claim_id").alias("row_id"), F.explode(F.array(*[F.struct(F.lit(f"claims.{k}").alias("source_field"), F.col(k).alias("text")) for k in ("label", "value")])).alias("_t")).select("row_id", "_t.*")
    own = glyph_cases(glyphs).select(F.lit("glyphs.ch").alias("source_field"), F.col("seq").alias("row_id"), F.lit(0).cast("long").alias("term_id"))
    return term_cases(texts, terms).unionByName(own)
