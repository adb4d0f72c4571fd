"""Text functions as Column expressions; only the 64-bit hash needs Arrow."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD_BREAK = "[ \\n\\t'\\\\/()\\[\\]{}:.;,!?]"
#: Characters and two-character marks between tokens; the marks come first, so they win where both fit.
TOKEN_BREAK = "[.;,!?] |[ \\n\\t'\"/\u2014()\\[\\]{}:]"
#: A full stop after an initial or an abbreviation ends no sentence; the look-back is five characters, and is done at breaks only.
SENTENCE_BREAK = "[.!?](?=[\\n\\t <])(?<![(>\\s](?:[A-Z]|Dr|[Ee]x|[Nn]o|[Vv]s|al|ca|[Ff]ig|[Vv]ol|i\\.e|e\\.g)\\.)[\\n\\t <]"
DEFAULT_STOP_WORDS = "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split()


def strip_tags(text: Column) -> Column:
    """Tags, closing tags, an unfinished layout tag at a line's end and the rest of one at its start go."""
    for pattern in ("(?s)<.+?>", "(?s)</.+?>", "(?m)<_pdf[^>]+$", "(?m)^[^ \\t]+/>"):
        text = F.regexp_replace(text, pattern, "")
    return text


def strip_simple_tags(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, "(?s)<.+?>", ""), "(?s)</.+?>", "")


def strip_layout_tags(text: Column) -> Column:
    return F.regexp_replace(text, "(?s)<_pdf.+?/>", "")


def collapse_space(text: Column) -> Column:
    """Trimmed, and every run of white space one blank."""
    return F.regexp_replace(F.regexp_replace(text, "^\\s+|\\s+$", ""), "\\s+", " ")


def clean_pcdata(parts: Column) -> Column:
    """Character data of an XML document, blank between parts, white space collapsed."""
    return collapse_space(F.array_join(parts, " "))


def words(text: Column) -> Column:
    """Split at every breaking character; empty words stay, so positions count characters of the text."""
    return F.split(text, WORD_BREAK, -1)


def terms(text: Column, case_sensitive: bool = False) -> Column:
    """Words for search: not empty, lower case unless asked otherwise."""
    return F.filter(words(text if case_sensitive else F.lower(text)), lambda w: w != "")


ANALYZED = "[\\p{L}\\p{N}]+(?:['.][\\p{L}\\p{N}]+)*"
LONGEST = 255


def found_words(text: Column, case_sensitive: bool = False) -> Column:
    """Every token of letters and digits, stop words too."""
    return F.regexp_extract_all(text if case_sensitive else F.lower(text), F.lit(ANALYZED), F.lit(0))


def analyzed_places(text: Column, stop_words: list[str] | None = None, case_sensitive: bool = False, longest: int = LONGEST) -> Column:
    """Tokens of letters and digits; stop words and those over ``longest`` characters are null, so the others keep their places."""
    found = found_words(text, case_sensitive)
    stop = DEFAULT_STOP_WORDS if stop_words is None else stop_words
    return F.transform(found, lambda w: F.when(~w.isin(*stop) & (F.length(w) <= longest), w) if stop else F.when(F.length(w) <= longest, w))


def analyzed(text: Column, stop_words: list[str] | None = None, case_sensitive: bool = False, longest: int = LONGEST) -> Column:
    """Tokens of letters and digits without stop words and those over ``longest`` characters."""
    return F.array_compact(analyzed_places(text, stop_words, case_sensitive, longest))


def running(values: Column) -> Column:
    """Running sums of an array of whole numbers, in the row; only the numbers cross to Python, in Arrow arrays."""

    @F.arrow_udf("array<int>")
    def run(v):
        import numpy as np
        import pyarrow as pa

        edges = v.offsets.to_numpy().astype(np.int64)
        sums = np.concatenate([[0], np.cumsum(v.values.to_numpy(zero_copy_only=False)[edges[0] : edges[-1]])])
        edges = edges - edges[0]
        own = (sums[1:] - np.repeat(sums[edges[:-1]], np.diff(edges))).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(own), mask=v.is_null())

    return run(values)


def tokens(text: Column) -> Column:
    """Spans between token breaks; breaks themselves aren't tokens here and empty spans go."""
    return F.filter(F.split(text, TOKEN_BREAK, -1), lambda w: w != "")


def normalized(word: Column) -> Column:
    """ASCII letters and digits only, in lower case."""
    return F.lower(F.regexp_replace(word, "[^A-Za-z0-9]", ""))


def space_tokens(text: Column) -> Column:
    """Words of a term; a term that begins with a blank has none."""
    return F.when(text.startswith(" "), F.array().cast("array<string>")).otherwise(F.filter(F.split(text, " "), lambda w: w != ""))


def printable(text: Column) -> Column:
    """Everything but printable ASCII and white space becomes a blank."""
    return F.regexp_replace(text, "[^\\x09-\\x0d\\x20-\\x7e]", " ")


_LIGATURES = {"\ufb00": "ff", "\ufb01": "fi", "\ufb02": "fl", "\ufb03": "ffi", "\ufb04": "ffl", "\u00e6": "ae", "\u00c6": "AE", "\u0153": "oe", "\u0152": "OE", "\u00df": "ss", "\u00b0": "degree", "\u00b5": "micro", "\u03bc": "micro", "\u00b1": "plus/minus", "\u00a9": "copyright"}
_FOLD_FROM = "\u00c0\u00c1\u00c2\u00c3\u00c4\u00c5\u00c7\u00c8\u00c9\u00ca\u00cb\u00cc\u00cd\u00ce\u00cf\u00d1\u00d2\u00d3\u00d4\u00d5\u00d6\u00d8\u00d9\u00da\u00db\u00dc\u00dd\u00e0\u00e1\u00e2\u00e3\u00e4\u00e5\u00e7\u00e8\u00e9\u00ea\u00eb\u00ec\u00ed\u00ee\u00ef\u00f1\u00f2\u00f3\u00f4\u00f5\u00f6\u00f8\u00f9\u00fa\u00fb\u00fc\u00fd\u00ff\u2018\u2019\u201c\u201d\u2013\u2014\u2212"
_FOLD_TO = "AAAAAACEEEEIIIINOOOOOOUUUUYaaaaaaceeeeiiiinoooooouuuuyy''\"\"---"


def ascii_text(text: Column) -> Column:
    """Ligatures and a few signs spelled out, accents dropped, what is left outside ASCII removed."""
    for sign, spelled in _LIGATURES.items():
        text = F.replace(text, F.lit(sign), F.lit(spelled))
    return F.regexp_replace(F.translate(text, _FOLD_FROM, _FOLD_TO), "[^\\x00-\\x7f]", "")


def without_byte_mark(text: Column) -> Column:
    """The byte 0xFF, as a character or spelled as an octal escape, goes."""
    return F.replace(F.replace(text, F.lit("\u00ff"), F.lit("")), F.lit("\\377"), F.lit(""))


def category_string(found: Column, categories: Column) -> Column:
    """``found`` words and a map from word to its categories to ``a|b<tab>NA<tab>...``."""
    return F.array_join(F.transform(found, lambda w: F.coalesce(F.array_join(categories[w], "|"), F.lit("NA"))), "\t")


def words_of_category(found: Column, per_word: Column, category: str) -> Column:
    """Sorted distinct words whose entry in ``per_word`` (``a|b`` strings by position) names the category."""
    pairs = F.filter(F.arrays_zip(found.alias("w"), per_word.alias("c")), lambda p: F.array_contains(F.split(p["c"], "\\|"), category))
    return F.array_sort(F.array_distinct(F.transform(pairs, lambda p: p["w"])))


def encode_corpora(corpora: Column) -> Column:
    return F.array_join(F.transform(corpora, lambda c: F.concat(F.lit("BG"), c, F.lit("ED"))), " ")


def decode_corpora(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("BG(.*?)ED"), F.lit(1))


def anchored(text: Column) -> Column:
    return F.concat(F.lit("BEGIN "), text, F.lit(" END"))


_SPECIAL = "!(){}[]^~:"


def escaped_query(text: str) -> str:
    """Query text with the marks that have no meaning for users taken literally."""
    return "".join(f"\\{c}" if c in _SPECIAL else c for c in text)


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def parent_name(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.element_at(parts, F.when(F.size(parts) > 1, -2).otherwise(-1)))


def file_stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), "\\.[^.]*$", "")


def without_suffixes(path: Column) -> Column:
    return F.replace(F.replace(path, F.lit(".gz"), F.lit("")), F.lit(".tpcas"), F.lit(""))


def attribute_text(attributes: Column) -> Column:
    """A map of attributes as ``a='v' b='w'``."""
    return F.array_join(F.transform(F.map_entries(attributes), lambda e: F.concat(e["key"], F.lit("='"), e["value"], F.lit("'"))), " ")


def layout_tag(tag: Column) -> Column:
    """Type and value of a layout tag: what follows its prefix, and what follows the equals sign."""
    inner = F.regexp_extract(tag, "(?s)<_pdf (.*?)/?>", 1)
    return F.struct(F.trim(F.split(inner, "=", 2)[0]).alias("tagtype"), F.coalesce(F.get(F.split(inner, "=", 2), F.lit(1)), F.lit("")).alias("value"))


ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789#@"


def short_id(number: Column) -> Column:
    """A non-negative number in base 64, most significant digit first."""
    n = number.cast("long")
    digits = F.transform(F.sequence(F.lit(10), F.lit(0), F.lit(-1)), lambda k: F.substring(F.lit(ALPHABET), (F.call_function("shiftright", n, k * 6).bitwiseAND(F.lit(63)) + 1).cast("int"), F.lit(1)))
    return F.regexp_replace(F.array_join(digits, ""), "^A+(?=.)", "")


def encoded_entities(text: Column) -> Column:
    """Text for an XML attribute in double quotes; white space other than blanks is kept as references."""
    for sign, spelled in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("\t", "&#9;"), ("\n", "&#10;"), ("\r", "&#13;")):
        text = F.replace(text, F.lit(sign), F.lit(spelled))
    return text


def decoded_entities(text: Column) -> Column:
    """Value of an XML attribute: plain white space is a blank, named and numeric references stand for their characters."""
    named = F.create_map(*(F.lit(x) for kv in {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}.items() for x in kv))

    def one(part: Column) -> Column:
        name = F.regexp_extract(part, "^(#x[0-9A-Fa-f]{1,6}|#[0-9]{1,7}|[a-z]+);", 1)
        number = F.when(name.startswith("#x"), F.conv(F.substr(name, F.lit(3)), 16, 10)).when(name.startswith("#"), F.substr(name, F.lit(2))).cast("long")
        sign = F.coalesce(F.when(number < 0x110000, F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")), named[name])
        return F.coalesce(F.concat(sign, F.substr(part, F.length(name) + 2)), F.concat(F.lit("&"), part))

    parts = F.split(F.translate(text, "\t\n\r", "   "), "&")
    return F.concat(parts[0], F.array_join(F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), one), ""))


def fnv(text: Column) -> Column:
    """FNV-1a over UTF-16 code units, 64 bits, 16 hex digits; a batch's texts advance together, a unit a step."""

    @F.pandas_udf("string")
    def run(values):
        import numpy as np
        import pandas as pd

        known = values.notna().to_numpy()
        data = [v.encode("utf-16-le", "surrogatepass") for v in values[known]]
        sizes = np.array([len(d) // 2 for d in data], np.int64)
        order = np.argsort(-sizes, kind="stable")
        units = np.frombuffer(b"".join(data), "<u2").astype(np.uint64)
        start, left = (np.cumsum(sizes) - sizes)[order], sizes[order]
        h = np.full(len(data), 0xCBF29CE484222325, np.uint64)
        longer = np.searchsorted(-left, -np.arange(1, int(left.max(initial=0)) + 1), side="right")
        for k, n in enumerate(longer.tolist()):
            h[:n] = (h[:n] ^ units[start[:n] + k]) * np.uint64(0x100000001B3)
        out, hexed = np.full(len(values), None, object), np.empty(len(data), object)
        hexed[order] = [f"{x:016x}" for x in h.tolist()]
        out[known] = hexed
        return pd.Series(out, dtype=object)

    return run(text)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; the plain product where one is zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, p: s + p)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(dot(a, b))


def string_width(text: Column, widths: Column, fallback: Column) -> Column:
    """Sum of character widths from a map, each missing one ``fallback``."""
    return F.aggregate(F.split(text, ""), F.lit(0.0), lambda s, c: s + F.when(c == "", 0.0).otherwise(F.coalesce(widths[c], fallback)))


def font_style(flags: Column, italic_angle: Column, name: Column) -> Column:
    """Booleans from a font descriptor; flag bits are tested counting from zero."""
    bit = lambda k: F.call_function("shiftright", flags.cast("int"), F.lit(k)).bitwiseAND(F.lit(1)) == 1
    low = F.lower(name)
    return F.struct(bit(0).alias("fixed"), bit(1).alias("serif"), bit(2).alias("symbolic"), bit(3).alias("script"), bit(5).alias("nonsymbolic"), (bit(6) | (italic_angle != 0) | low.contains("italic") | low.contains("oblique")).alias("italic"), (bit(18) | low.contains("bold")).alias("bold"), low.contains("symbol").alias("greek"))


def variations(text: Column) -> Column:
    """Spellings of a term, ``a|b|c``, trimmed; empty ones go."""
    return F.filter(F.transform(F.split(text, "\\|"), lambda v: F.trim(v)), lambda v: v != "")


def cleaned_details(frame, columns: list[str], tags: bool = True, space: bool = True):
    """Tag and white-space clean-up of string columns and of arrays of sentence structs, empty sentences dropped."""

    def one(c: Column) -> Column:
        c = strip_tags(c) if tags else c
        return collapse_space(c) if space else c

    for name in columns:
        if dict(frame.dtypes)[name].startswith("array<struct"):
            frame = frame.withColumn(name, F.filter(F.transform(name, lambda s: s.withField("sentence", one(s["sentence"]))), lambda s: ~s["sentence"].isin("", " ")))
        else:
            frame = frame.withColumn(name, one(F.col(name)))
    return frame
