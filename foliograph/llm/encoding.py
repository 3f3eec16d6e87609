"""Garbled text from wrong character encoding, learned from clean near-twins.

Records are glyph lines and font names. A wrong decoding leaves ASCII characters alone, so a garbled record and its clean
twin share the text that is left when all other characters are stripped. Records meet on that key (digits as one mark, since
figures vary); in each group every text that is sound and at least as frequent is a clean side. Aligned between the shared ASCII
characters, every stretch of a garbled record faces its clean original. From the aligned stretches come two kinds of transformation, each kept
only with enough support: a pair or chain of encodings that turns the clean stretch into the garbled one, and a map of single
characters for old one-byte encodings of fonts. These are then applied to all remaining records, with or without a twin.

One encoding taken for another is told by the twin itself: damaged texts join on the whole form that a clean one takes on.

Groups are aggregates of distinct texts with counts. All clean sides of a group vote, however many, but no texts are paired: stretches
meet by an equi-join on their original, letters by one on their place. What is collected is bounded: encodings of a fixed list, and
one entry a character.

Defined results: null and empty texts are no cases; a replacement character is always a lost one; repeated rows are one case;
an empty table gives no cases; other columns are not read.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliograph.llm.glyphstream import CHUNK, PAD, Lines, by_lines, whole_groups, with_open
from foliograph.session import cut

#: One-byte encodings that text in UTF-8 is taken for. Fixed values.
ENCODINGS = ("latin_1", "cp1252", "cp1250", "cp1251", "cp1253", "cp1254", "cp1257", "cp1258", "cp437", "cp850", "cp852", "cp866", "mac_roman", "mac_cyrillic", "koi8_r", "iso8859_2", "iso8859_5", "iso8859_15", "cp874", "cp775")
#: Encodings for text in one of these taken for another.
WRITTEN = ("cp1251", "koi8_r", "cp866", "mac_roman", "mac_cyrillic", "cp437", "cp850", "cp1250", "cp1253", "cp1258", "gb18030", "big5", "shift_jis", "euc_jp", "euc_kr", "cp874")
READ = ("cp1252", "latin_1", "cp1251", "mac_roman", "cp437")
#: Aligned characters that a transformation must explain; share of its votes that an entry of the map needs.
SUPPORT, MAP_SHARE = 4, 0.6
#: What a letter's vote is divided from, so that shares of it stay whole numbers.
VOTE = 10**12
_OTHER = regex.compile(r"[^\x00-\x7f]+")
#: Symbols that stand beside letters in sound text: quotation marks, units, and what touches no two letters.
_ORDINARY_SYMBOL = regex.compile(r"[«»¿¡]|(?<=\d|\b[mM]|\bkm|\bcm)[²³]|(?<=\b[Nn])[°º]|[°](?=C\b|F\b)|[µ](?=[mgls]\b)|(?<=\d)[°ºª¹²³%]")
#: A symbol within a word. The soft hyphen alone shows nothing: it counts beside another letter of one byte.
_LEGACY_SYMBOL = regex.compile(r"\p{L}[¢-©¬®-¾×÷]|[¢-©¬®-¾×÷]\p{L}|\xad[À-ÿ]|[À-ÿ]\xad|[¢-©¬®-¾]\xad")


@lru_cache(64)
def byte_of(encoding: str) -> dict[str, int]:
    """character -> byte; bytes that the encoding leaves open stand for themselves, as most decoders have it."""
    out = {}
    for b in range(256):
        try:
            c = bytes([b]).decode(encoding)
        except UnicodeDecodeError:
            c = chr(b)
        out.setdefault(c, b)
    return out


@lru_cache(64)
def char_of(encoding: str) -> dict[int, str]:
    return {b: c for c, b in byte_of(encoding).items()}


def wrongly(clean: str, encoding: str) -> str:
    """Text in UTF-8, decoded as if it were in ``encoding``."""
    table = char_of(encoding)
    return "".join(table.get(b, chr(b)) for b in clean.encode("utf-8", "replace"))


def regained(garbled: str, encoding: str) -> str | None:
    """The text that ``wrongly`` made this of; None if there is none."""
    table = byte_of(encoding)
    try:
        return bytes([ord(c) if c < "\x80" else table[c] for c in garbled]).decode("utf-8")
    except (KeyError, UnicodeDecodeError):
        return None


def mistaken(clean: str, written: str, read: str) -> str | None:
    """Text in ``written``, decoded as if it were in ``read``."""
    r = char_of(read)
    try:
        return "".join(r.get(b, chr(b)) for b in clean.encode(written))
    except UnicodeEncodeError:
        return None


class Model(NamedTuple):
    """What was learned: encodings that UTF-8 was taken for, the map of an old font encoding's letters, and the scripts of clean text."""

    encodings: tuple[str, ...]
    letters: dict[str, str]
    repertoire: frozenset[str] | None = None


#: For a look at text whose transformations haven't been learned (p2 asks whether a character belongs to p4).
ANY = Model(("cp1252", "latin_1", "cp1251", "mac_roman", "cp437", "cp1258"), {})


@lru_cache(1 << 16)
def _undone(stretch: str, encodings: tuple[str, ...]) -> str | None:
    """The original of a stretch of non-ASCII characters that is wrongly decoded UTF-8 throughout, also where that happened twice."""
    if len(stretch) < 2:
        return None
    for e in encodings:
        if (y := regained(stretch, e)) is not None and y != stretch and _sound(y):
            if len(y) > 1 and not y.isascii():
                again = _OTHER.sub(lambda m: _undone(m[0], encodings) or m[0], y)
                return again
            return y
    return None


#: Characters that no text here is written in; an original that has them was none. Those that one-byte encodings have may stand
#: in text that was wrongly decoded twice.
_UNSOUND = regex.compile(r"[\p{Co}\p{Cn}\p{Cs}\p{Armenian}\p{Hebrew}\p{Syriac}\p{Nko}\p{Thaana}\u0180-\u0191\u0193-\u019f\u01a2-\u01ae\u01b1-\u02c5\u02c8-\u02d7\u02de-\u036f\u0370-\u0385\u03d0-\u03ff\u0460-\u058f\u0600-\u0605]")


def _sound(text: str) -> bool:
    return not _UNSOUND.search(text)


SCRIPTS = ("Latin", "Cyrillic", "Greek", "Han", "Hiragana", "Katakana", "Hangul", "Thai", "Arabic", "Devanagari")
_SCRIPT = [regex.compile(rf"\p{{{s}}}") for s in SCRIPTS]


_COMMON = regex.compile(r"[\p{Common}\p{Inherited}]")


@lru_cache(1 << 14)
def _script(c: str) -> str:
    return next((s for s, p in zip(SCRIPTS, _SCRIPT, strict=True) if p.match(c)), "other" if c.isalpha() and not _COMMON.match(c) else "")


def scripts_of(text: str) -> set[str]:
    """The scripts of a text's letters."""
    return {_script(c) for c in text} - {""}


def _pieces(stretch: str, model: Model, in_word: bool) -> list[tuple[int, int, str]]:
    """(start, end, original) of the wrongly decoded parts of a stretch; the longest first from each place.

    A part that is all letters of one alphabet says nothing by itself, unless it is the whole stretch in Latin, or
    Cyrillic within a Latin word (``in_word``). An original has letters of the scripts of clean text only.
    """
    encodings, known = model.encodings, model.repertoire
    whole = _undone(stretch, encodings)
    if whole is not None and (known is None or known.issuperset(scripts_of(whole))):
        return [] if not in_word and _ONE_ALPHABET.fullmatch(stretch) else [(0, len(stretch), whole)]
    # A part of more than 40 characters comes as several: whole characters of its original end at many places before.
    out, i, n = [], 0, len(stretch)
    while i < n - 1:
        for j in range(min(n, i + 40), i + 1, -1):
            part = stretch[i:j]
            if (y := _undone(part, encodings)) is not None and not _LETTERS.fullmatch(part) and (known is None or known.issuperset(scripts_of(y))):
                out.append((i, j, y))
                i = j
                break
        else:
            i += 1
    return out


_ONE_ALPHABET = regex.compile(r"[А-яЁё]+")
_LETTERS = regex.compile(r"[А-яЁё]+|[À-ÖØ-öø-ɏḀ-ỿ]+")


def _in_word(text: str, m: regex.Match) -> bool:
    return "a" <= text[m.end() : m.end() + 1].lower() <= "z" or m.start() > 0 and "a" <= text[m.start() - 1].lower() <= "z"


def damaged_spans(text: str, model: Model = ANY) -> list[tuple[int, int]]:
    """Where a text is wrongly decoded: stretches that can be undone, and lost characters."""
    out = [(m.start() + a, m.start() + z) for m in _OTHER.finditer(text) for a, z, _ in _pieces(m[0], model, _in_word(text, m))]
    return out + [(m.start(), m.end()) for m in regex.finditer("�+", text)]


def legacy_line(text: str) -> bool:
    """Whether a line holds letters of an old one-byte font encoding: no character beyond one byte, and symbols within words."""
    return not any(c > "\xff" for c in text) and _LEGACY_SYMBOL.search(_ORDINARY_SYMBOL.sub(" ", text)) is not None


class Twin(NamedTuple):
    """What a damaged field's clean twin tells: the field as ``_fields`` has it, its original, and how it was damaged (LETTERS)."""

    part: str
    original: str
    how: str


#: Damaged by an old font encoding, whose letters the model has.
LETTERS = "letters"
_UNIT = regex.compile(r"[0-9][0-9.,]*|[ \t\n\x0b\f\r]+|.", regex.DOTALL)
_PARTING = regex.compile(r" *(?::|\.{3,}) *")


def fields_of(text: str) -> list[tuple[int, int, str]]:
    """(start, end, part) of a text's fields, parted and written as ``_fields`` does it."""
    head = regex.match(r"[A-Z]{6}\+", text)
    units = [(m.start(), m.end(), "0" if "0" <= m[0][0] <= "9" else " " if m[0][0] in " \t\n\x0b\f\r" else m[0]) for m in _UNIT.finditer(text, head.end() if head else 0)]
    plain = "".join(u for _, _, u in units)
    out, at = [], 0
    for a, z in [*[m.span() for m in _PARTING.finditer(plain)], (len(plain), len(plain))]:
        part = plain[at:a]
        if body := part.strip(" "):
            first = at + len(part) - len(part.lstrip(" "))
            out.append((units[first][0], units[first + len(body) - 1][1], body))
        at = z
    return out


def _by_letters(text: str, model: Model) -> tuple[str, list[int]]:
    return "".join(model.letters.get(c, c) for c in text), [i for i, c in enumerate(text) if c > "\x7f" and model.letters.get(c) != c]


def _by_twin(text: str, twin: Twin) -> tuple[str, list[int]] | None:
    """A field's original and its damaged places: every character that the bytes of a foreign one became. None if it isn't the twin's after all."""
    w, _, r = twin.how.partition(">")
    out, places, i = [], [], 0
    for c in twin.original:
        if c in "0 " and (m := _UNIT.match(text, i)) and normal(f"x{m[0]}x") == f"x{c}x":
            out.append(m[0])
            i = m.end()
            continue
        form = c if c < "\x80" else mistaken(c, w, r)
        if form is None or not text.startswith(form, i):
            return None
        if form != c:
            places += range(i, i + len(form))
        out.append(c)
        i += len(form)
    return ("".join(out), places) if i == len(text) else None


def restored_by(text: str, model: Model, twins: Sequence[Twin]) -> tuple[str, list[int]]:
    """As ``restored``, where twins tell of some of the text's fields that they are damaged."""
    known: dict[str, list[Twin]] = defaultdict(list)
    for t in twins:
        known[t.part].append(t)
    fields = [(a, z, next((x for t in known[part] if t.how != LETTERS and (x := _by_twin(text[a:z], t))), None)) for a, z, part in fields_of(text) if part in known] if known else []
    fields = [(a, z, x or _by_letters(text[a:z], model)) for a, z, x in fields if x or any(t.how == LETTERS for t in known[normal(text[a:z])])]
    # An old font's line is so throughout, unless it has characters that are none of one byte.
    if not any(c > "\xff" for c in text) and any(t.how == LETTERS for a, z, _ in fields for t in known[normal(text[a:z])]):
        return _by_letters(text, model)
    out, places, at = [], [], 0
    for a, z, whole in fields:
        for start, (y, bad) in ((at, restored(text[at:a], model)), (a, whole)):
            out.append(y)
            places += [start + i for i in bad]
        at = z
    y, bad = restored(text[at:], model)
    return "".join([*out, y]), places + [at + i for i in bad]


def restored(text: str, model: Model) -> tuple[str, list[int]]:
    """The text with what can be regained, and the places (code points) of its damaged characters."""
    places = [i for i, c in enumerate(text) if c == "�"]
    out, at, found = [], 0, False
    for m in _OTHER.finditer(text):
        for a, z, y in _pieces(m[0], model, found or _in_word(text, m)):
            out += [text[at : m.start() + a], y]
            places += range(m.start() + a, m.start() + z)
            at, found = m.start() + z, True
    if found or places:
        return "".join([*out, text[at:]]), sorted(places)
    if model.letters and legacy_line(text):
        return _by_letters(text, model)
    return text, []


# ---- records ---------------------------------------------------------------------------------------------------------

_LINE = "doc_id string, text string, seqs array<long>, at array<int>"


def line_records(glyphs: DataFrame, chunk: int = CHUNK, pad: int = PAD) -> DataFrame:
    """doc_id, text, seqs, at: drawn lines with any non-ASCII character; at is the place in text of each such row and of the row after it,
    which may be a character's last byte."""

    def kernel(width: int):
        def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for t in whole_groups(batches, ["doc_id", "page", "chunk"]):
                lines = Lines(t, chunk, width, pad)
                ch, again, home, seq = lines.ch, lines.again, lines.home, lines.seq
                rows, texts, seqs, ats = [], [], [], []
                for a, z, whole in zip(lines.start.tolist(), lines.end.tolist(), lines.whole.tolist(), strict=True):
                    joined = "".join([c for c in ch[a:z] if c])
                    if joined.isascii() or not whole or not home[a:z].any():
                        continue
                    text, own, place, n = [], [], [], 0
                    last = -1
                    for i in range(a, z):
                        c = ch[i]
                        if not c:
                            continue
                        if not again[i] or last < 0:
                            last = n
                            text.append(c)
                            n += len(c)
                        if home[i] and not (c.isascii() and "".join(text[-2:-1]).isascii()):
                            own.append(int(seq[i]))
                            place.append(last)
                    rows.append(a)
                    texts.append("".join(text))
                    seqs.append(own)
                    ats.append(place)
                d = lines.table.column("doc_id").take(pa.array(rows, pa.int64()))
                doc = pa.concat_arrays(d.chunks) if d.num_chunks else pa.array([], pa.string())
                yield with_open([doc, pa.array(texts, pa.string()), pa.array(seqs, pa.list_(pa.int64())), pa.array(ats, pa.list_(pa.int32()))], ["doc_id", "text", "seqs", "at"], lines)

        return records

    return by_lines(glyphs, ["ch", "x0", "top", "size"], kernel, _LINE, chunk, pad)


def name_records(fonts: DataFrame, audits: DataFrame) -> DataFrame:
    """source_field, doc_id, item of every font name with any non-ASCII character."""
    named = [
        fonts.select(F.lit("fontname").alias("source_field"), "doc_id", F.col("base_font").alias("item")),
        audits.select(F.lit("missing").alias("source_field"), "doc_id", F.explode("missing").alias("item")),
        audits.select(F.lit("affected_characters").alias("source_field"), "doc_id", F.explode(F.map_keys("affected_characters")).alias("item")),
    ]
    return named[0].unionByName(named[1]).unionByName(named[2]).filter(F.col("item").rlike(r"[^\x00-\x7f]")).distinct()


# ---- learning --------------------------------------------------------------------------------------------------------


def _fields(text: F.Column) -> F.Column:
    """A line's parts around colons and leader dots, digits as one mark, blanks as one; a font name without its subset prefix."""
    text = F.regexp_replace(text, r"^[A-Z]{6}\+", "")
    text = F.regexp_replace(F.regexp_replace(text, r"[0-9][0-9.,]*", "0"), r"\s+", " ")
    return F.filter(F.transform(F.split(text, r"\s*(?::|\.{3,})\s*"), lambda p: F.trim(p)), lambda p: p.rlike(r"[^\x00-\x7f]"))


def aligned(garbled: str, clean: str, equal: bool = False) -> list[tuple[str, str]]:
    """The stretches of two texts with one ASCII skeleton, between the ASCII characters they share: those that differ, or all."""
    a, b = regex.split(r"[\x00-\x7f]", garbled), regex.split(r"[\x00-\x7f]", clean)
    return [(x, y) for x, y in zip(a, b, strict=False) if (equal or x != y) and x and y] if len(a) == len(b) else []


def explained(g: str, c: str) -> list[str]:
    """The encodings that turn c, in UTF-8, into g."""
    out = [f"utf8>{e}" for e in ENCODINGS if wrongly(c, e) == g]
    if not out and len(g) >= 3 * len(c):
        out = [f"utf8>{e}" for e in ENCODINGS if any(wrongly(wrongly(c, e), f) == g for f in (e, "cp1252", "latin_1"))]
    return out


def normal(text: str) -> str:
    """A part as ``_fields`` writes it: digits as one mark, blanks as one."""
    return "".join("0" if "0" <= m[0][0] <= "9" else " " if m[0][0] in " \t\n\x0b\f\r" else m[0] for m in _UNIT.finditer(text)).strip(" ")


@lru_cache(16)
def _read_table(read: str) -> dict[int, str]:
    return {b: char_of(read).get(b, chr(b)) for b in range(128, 256)}


def forms(clean: str) -> dict[str, list[str]]:
    """What a clean part looks like, written in one of the encodings and read in another: form -> pairs. Two characters at least must differ."""
    out: dict[str, list[str]] = defaultdict(list)
    if sum(x > "\x7f" for x in clean) < 2:
        return out
    for w in WRITTEN:
        try:
            raw = clean.encode(w).decode("latin_1")
        except UnicodeEncodeError:
            continue
        for r in READ:
            if w != r and (form := normal(raw.translate(_read_table(r)))) != clean:
                out[form].append(f"{w}>{r}")
    return out


def _forms_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """kind, part (what the clean part looks like), clean, n (its count), name (pairs joined by "|")."""
    names = ["kind", "part", "clean", "n", "name"]
    for b in batches:
        rows = [(k, f, c, n, "|".join(w)) for k, c, n in zip(*[x.to_pylist() for x in b.columns], strict=True) for f, w in forms(c).items()]
        columns = zip(*rows, strict=True) if rows else [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64() if n == "n" else pa.string()) for n, x in zip(names, columns, strict=True)], names)


def exact_twins(parts: DataFrame, model: Model) -> DataFrame:
    """name, n, garbled, clean: parts (kind, part, count) that are another, as frequent one in wrong encodings. An equi-join on the whole text.
    The other one is sound: it holds no UTF-8 decoded wrongly (as ``model`` has it) and no old font's letters.

    A clean part is spread over a fixed list of encodings, whatever ASCII characters they leave, so no group of parts is paired.
    """
    sound = parts.filter("part NOT LIKE '%�%'").select("kind", "part", "count")
    spread = sound.mapInArrow(_forms_of, "kind string, part string, clean string, n long, name string")
    met = sound.join(spread, ["kind", "part"]).filter("count <= n AND part <> clean")
    met = met.select("name", F.length(F.regexp_replace("clean", r"[\x00-\x7f]", "")).cast("long").alias("n"), F.col("part").alias("garbled"), "clean")

    def sound_sides(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([not (damaged_spans(c) or damaged_spans(c, model) or legacy_line(c)) for c in b.column(3).to_pylist()], pa.bool_()))

    return met.mapInArrow(sound_sides, "name string, n long, garbled string, clean string")


@lru_cache(1 << 16)
def originals(stretch: str) -> dict[str, str]:
    """original -> names (joined by "|"), for all that ``explained`` has a name for."""
    if len(stretch) < 2:
        return {}
    once = {e: y for e in ENCODINGS if (y := regained(stretch, e)) is not None}
    twice = [regained(z, e) for f, z in once.items() for e in (ENCODINGS if f in ("cp1252", "latin_1") else (f,))]
    return {y: "|".join(names) for y in {*once.values(), *twice} - {None} if (names := explained(stretch, y))}


def _originals_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, at, original, name, count: of every stretch of the parts (key, part, count) that is wrongly decoded UTF-8 as a whole."""
    types = [("key", pa.string()), ("at", pa.int32()), ("original", pa.string()), ("name", pa.string()), ("count", pa.int64())]
    for b in batches:
        rows = [(k, i, y, names, n) for k, p, n in zip(*[x.to_pylist() for x in b.columns], strict=True) for i, x in enumerate(regex.split(r"[\x00-\x7f]", p)) for y, names in originals(x).items()]
        columns = zip(*rows, strict=True) if rows else [()] * len(types)
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, (_, t) in zip(columns, types, strict=True)], [n for n, _ in types])


def _where(parts: DataFrame, test: Callable[[str], bool]) -> DataFrame:
    """The rows whose part passes."""

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([test(p) for p in b.column("part").to_pylist()], pa.bool_()))

    return parts.mapInArrow(passed, parts.schema)


def _utf8_votes(keyed: DataFrame) -> DataFrame:
    """name, n: n aligned characters speak for one of the names (joined by "|"), over all pairs of a part and a clean side of its key.

    A stretch tells its possible originals by itself, so it meets the clean sides that have one of them at its place: an equi-join on both.
    """
    place = ["key", "at", "original"]
    told = cut(keyed.filter(F.col("part").rlike(r"[^\x00-\x7f]{2}")).select("key", "part", "count").mapInArrow(_originals_of, "key string, at int, original string, name string, count long").groupBy(*place, "name", "count").agg(F.count(F.lit(1)).alias("m")))
    sides = keyed.select("key", "part", F.col("count").alias("c"), F.posexplode(F.split("part", r"[\x00-\x7f]")).alias("at", "original"))
    sides = _where(sides.join(told.select(place).distinct(), place, "left_semi"), lambda c: not damaged_spans(c))
    sides = sides.groupBy(*place, "c").agg(F.count(F.lit(1)).alias("k"))
    return told.join(sides, place).filter("count <= c").groupBy("name").agg(F.sum(F.expr("m * k * length(original)")).alias("n"))


def _letter_votes(keyed: DataFrame, old: DataFrame) -> DataFrame:
    """p, q, n: votes for q as the original of p. Each character of a part of ``old`` has ``VOTE`` votes, in equal shares for what its clean sides have at its place.

    A clean side of a part has the same key, is as frequent, is sound, and has as many characters in every stretch that both have; it differs in one of these.
    Which stretches both have follows from the pairs of masks of a key; given those, outlines are equal and characters meet by place. A place has few
    different characters and counts, however many texts share it.
    """
    mask = F.array_join(F.transform("places", lambda s: F.when(s == "", "0").otherwise("1")), "")
    placed = lambda df, name: df.select("key", "part", "count", F.split("part", r"[\x00-\x7f]").alias("places")).withColumn(name, mask)
    olds, others = placed(old, "mine"), placed(keyed.join(old.select("key").distinct(), "key", "left_semi"), "theirs")
    masks = cut(olds.select("key", "mine").distinct().join(others.select("key", "theirs").distinct(), "key"))
    pair = ["key", "mine", "theirs", "outline"]

    def outlined(df: DataFrame, own: str, other: str) -> DataFrame:
        common = F.expr(f"array_join(transform(places, (s, i) -> if(substring({other}, i + 1, 1) = '1', s, '')), ' ')")
        df = df.join(masks, ["key", own]).withColumn("common", common).filter(F.col("common").rlike("[^ ]"))
        return df.select(*pair[:3], F.regexp_replace("common", "[^ ]", "x").alias("outline"), "common", "part", "count")

    olds = cut(outlined(olds, "mine", "theirs"))
    sides = outlined(others, "theirs", "mine").join(olds.select(pair).distinct(), pair, "left_semi")
    sides = _where(sides, lambda c: not (damaged_spans(c) or legacy_line(c)))
    sides = cut(sides.groupBy(*pair, "common", F.col("count").alias("c")).agg(F.count(F.lit(1)).alias("k")))
    # How many clean sides a part has: those of its outline, without those that have the very same common stretches.
    met = olds.select(*pair, "count").distinct().join(sides.groupBy(*pair, "c").agg(F.sum("k").alias("k")), pair).filter("count <= c").groupBy(*pair, "count").agg(F.sum("k").alias("all"))
    same = olds.join(sides, [*pair, "common"]).filter("count <= c").groupBy(*pair, "part").agg(F.sum("k").alias("same"))
    olds = olds.join(met, [*pair, "count"]).join(same, [*pair, "part"], "left").fillna(0, ["same"])
    shares = olds.groupBy("key", "part").agg(F.sum(F.expr("`all` - same")).alias("n")).filter("n > 0").select("key", "part", F.expr(f"cast({VOTE} div n as decimal(38,0))").alias("share"))

    def characters(df: DataFrame, name: str) -> DataFrame:
        return df.select("*", F.posexplode(F.split("common", "")).alias("at", name)).filter(~F.col(name).isin("", " "))

    mine = cut(characters(olds.join(shares, ["key", "part"]), "p").groupBy(*pair, "count", "at", "p").agg(F.sum("share").alias("share"), F.sum(F.expr("share * same")).cast("decimal(38,0)").alias("same")))
    theirs = characters(sides, "q").groupBy(*pair, "c", "at", "q").agg(F.sum("k").alias("k"))
    votes = mine.join(theirs, [*pair, "at"]).filter("count <= c").select("p", "q", F.expr("cast(share * k as decimal(38,0))").alias("n"))
    less = mine.filter("same > 0").select("p", F.col("p").alias("q"), F.expr("cast(-same as decimal(38,0))").alias("n"))
    return votes.unionByName(less).groupBy("p", "q").agg(F.sum("n").alias("n")).filter("n > 0")


def learned(records: DataFrame, support: int = SUPPORT) -> tuple[Model, DataFrame, DataFrame]:
    """The transformations that the records (kind, text) show, and twins (part, original): those that differ by one encoding taken
    for another, and those that differ by the letters of an old font encoding.

    Two one-byte encodings turn any text into some other text; there only the twin tells that it was so. So these are applied by the twin.
    """
    parts = records.select("kind", F.explode(_fields(F.col("text"))).alias("part")).groupBy("kind", "part").count()
    parts = cut(parts)
    # Of a short text without ASCII letters only its exact form tells.
    long = parts.filter(F.col("part").rlike("[A-Za-z0]|[^\x00-\x7f]{4}"))
    keyed = long.filter("part NOT LIKE '%�%'").withColumn("key", F.concat_ws(":", "kind", F.regexp_replace("part", r"[^\x00-\x7f]", "")))
    # One row for each set of encodings, or set of pairs: bounded by the lists above.
    summed = lambda df: {r.name: r.n for r in df.groupBy("name").agg(F.sum("n").alias("n")).collect()}
    encodings = _cover(summed(_utf8_votes(keyed)), support)
    told = Model(tuple(x.removeprefix("utf8>") for x in encodings), {})
    exact = cut(exact_twins(parts, told))
    legacy = _cover(summed(exact), support)
    # What is a clean part in wrong encodings as a whole says nothing of single letters.
    old = keyed.filter(~F.col("part").rlike(r"[^\x00-\xff]") & F.col("part").rlike(r"[\xa2-\xbe\xd7\xf7]"))
    old = cut(_where(old.join(exact.select(F.col("garbled").alias("part")).distinct(), "part", "left_anti"), legacy_line))
    # One row a character of one byte.
    best = _letter_votes(keyed, old).groupBy("p").agg(F.max(F.struct("n", "q")).alias("best"), F.sum("n").alias("n")).collect()
    letters = {r.p: r.best.q for r in best if int(r.best.n) >= MAP_SHARE * int(r.n)}
    lettered = _lettered(long, letters)
    known = exact.filter(F.arrays_overlap(F.split("name", r"\|"), F.array(*[F.lit(x) for x in legacy or ("",)]))).select(F.col("garbled").alias("part"), F.col("clean").alias("original"), F.array_intersect(F.array(*[F.lit(x) for x in legacy or ("",)]), F.split("name", r"\|"))[0].alias("how")).distinct()
    sound = _where(keyed.filter("count > 1").select("part"), lambda p: not damaged_spans(p, told))
    repertoire = frozenset(s for s, n in zip(SCRIPTS, sound.agg(*[F.sum(F.regexp_count("part", F.lit(rf"\p{{Is{s}}}"))) for s in SCRIPTS]).first(), strict=True) if (n or 0) >= support)
    return Model(told.encodings, letters, repertoire), known, lettered


def _lettered(parts: DataFrame, letters: dict[str, str]) -> DataFrame:
    """part, original: parts (kind, part, count) of lines whose letters, mapped one and all, make a frequent part. So no symbol has to tell."""
    lines = parts.filter("kind = 'line'")
    changed = sorted(g for g, c in letters.items() if g != c)
    if not changed:
        return lines.select("part", F.col("part").alias("original")).limit(0)
    one = lambda cs: "".join(f"\\x{ord(c):02x}" for c in cs)
    old = lines.filter(F.col("part").rlike(rf"[{one(changed)}]") & ~F.col("part").rlike(rf"[^\x00-\x7f{one(letters)}]"))
    old = old.select("part", "count", F.translate("part", "".join(letters), "".join(letters.values())).alias("original"))
    clean = lines.filter("count > 1").select(F.col("part").alias("original"), F.col("count").alias("n"))
    return old.join(clean, "original").filter("n >= count").select("part", "original")


def _cover(votes: dict[str, int], support: int) -> list[str]:
    """Names, the best first, until no other explains ``support`` characters that the chosen ones leave open."""
    left, out = {frozenset(k.split("|")): n for k, n in votes.items()}, []
    while left:
        score: Counter = Counter()
        for names, n in left.items():
            score.update({x: n for x in names})
        best, n = min(score.items(), key=lambda x: (-x[1], x[0]))
        if n < support:
            break
        out.append(best)
        left = {k: v for k, v in left.items() if best not in k}
    return out


# ---- application -----------------------------------------------------------------------------------------------------


def _told(texts: DataFrame, twins: DataFrame) -> DataFrame:
    """text, twins: of each distinct text the twins (part, original, how) of its fields; texts without any are left out."""
    by = texts.select("text").distinct().select("text", F.explode(F.array_distinct(_fields(F.col("text")))).alias("part"))
    return by.join(twins, "part").groupBy("text").agg(F.array_sort(F.collect_set(F.struct("part", "original", "how"))).alias("twins"))


def damaged(lines: DataFrame, names: DataFrame, model: Model, twins: DataFrame, lettered: DataFrame) -> DataFrame:
    """source_field, doc_id, item, original of every damaged glyph row and font name; for a glyph the original is its line's."""

    def glyphs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = lru_cache(1 << 15)(lambda t, twins: restored_by(t, model, twins))
        for b in batches:
            row, item, original = [], [], []
            for k, (t, seqs, at, told) in enumerate(zip(*[b.column(i).to_pylist() for i in range(1, 5)], strict=True)):
                y, places = known(t, tuple(Twin(**x) for x in told or ()))
                if places:
                    bad = set(places)
                    for s, p in zip(seqs, at, strict=True):
                        if p in bad:
                            row.append(k)
                            item.append(str(s))
                            original.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(["ch"] * len(row), pa.string()), b.column(0).take(pa.array(row, pa.int64())), pa.array(item, pa.string()), pa.array(original, pa.string())], ["source_field", "doc_id", "item", "original"])

    def fonts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(k, y) for k, (t, told) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)) for y, places in [restored_by(t, model, [Twin(**x) for x in told or ()])] if places]
            take = pa.array([k for k, _ in found], pa.int64())
            yield pa.RecordBatch.from_arrays([*[c.take(take) for c in b.columns[:3]], pa.array([y for _, y in found], pa.string())], ["source_field", "doc_id", "item", "original"])

    schema = "source_field string, doc_id string, item string, original string"
    names = names.select("source_field", "doc_id", "item")
    told = lines.join(_told(lines, twins.unionByName(lettered.withColumn("how", F.lit(LETTERS)))), "text", "left").select("doc_id", "text", "seqs", "at", "twins")
    named = names.join(_told(names.select(F.col("item").alias("text")), twins).withColumnRenamed("text", "item"), "item", "left").select("source_field", "doc_id", "item", "twins")
    return told.mapInArrow(glyphs, schema).unionByName(named.mapInArrow(fonts, schema))


def garbled(glyphs: DataFrame, fonts: DataFrame, audits: DataFrame) -> DataFrame:
    """Learns from all records and applies what was learned to all of them."""
    lines, names = line_records(glyphs), cut(name_records(fonts, audits))
    model, twins, lettered = learned(lines.select(F.lit("line").alias("kind"), "text").unionByName(names.select(F.lit("name").alias("kind"), F.col("item").alias("text"))))
    return damaged(lines, names, model, twins, lettered)
