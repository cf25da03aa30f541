"""Text functions for code search: tokens, identifiers, names, hashes, ids.

Column functions are built-in expressions.  ``tokenize`` also has an Arrow
form for whole corpora, because nested higher-order functions are interpreted
and repeat their sub-expressions.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from itertools import chain

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# Characters that hold a token together, separators inside one,
# and the borders between words of mixed case.
NOT_TOKEN = r"[^A-Za-z0-9_.$/-]+"
SEPARATORS = r"[_\-./]+"
CASE_BORDER = r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])"

# Words that a full-text query leaves out.
QUERY_STOPWORDS = frozenset((
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "can", "did", "do", "does", "for", "from", "had", "has", "have", "how", "i", "if", "in",
    "into", "is", "it", "its", "me", "of", "on", "or", "our", "out", "should", "that", "the", "their", "then", "there", "these", "they", "this", "to",
    "up", "us", "was", "we", "were", "what", "when", "where", "which", "who", "why", "will", "with", "would", "you", "your",
))
# Words that a symbol query leaves out.
SYMBOL_STOPWORDS = frozenset((
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "can", "do", "does", "for", "from", "get", "has", "have", "how", "i", "if", "in", "is",
    "it", "its", "me", "of", "on", "or", "our", "out", "set", "that", "the", "then", "this", "to", "up", "us", "use", "we", "what", "when", "where",
    "which", "who", "why", "with", "you", "your",
))

_TOKEN = re.compile(NOT_TOKEN.replace("[^", "["))
_NOT_TOKEN, _SEPARATORS, _BORDER = re.compile(NOT_TOKEN), re.compile(SEPARATORS), re.compile(CASE_BORDER)


def expand(raw: str) -> list[str]:
    """All forms of one raw token: itself, its parts, its words, its words joined."""
    forms, words = {raw.lower(): None}, []
    for part in filter(None, _SEPARATORS.split(raw)):
        forms[part.lower()] = None
        for word in filter(None, _BORDER.split(part)):
            words.append(word.lower())
            forms[words[-1]] = None
    if len(words) > 1:
        forms["".join(words)] = None
    return list(forms)


def tokenize_text(text: str) -> list[str]:
    """Distinct tokens of a text in order of first appearance."""
    return list(dict.fromkeys(f for raw in _NOT_TOKEN.split(text) if raw for f in expand(raw)))


def normalize_text(name: str) -> str:
    return re.sub("[^a-z0-9]", "", name.lower())


def query_terms(query: str) -> list[str]:
    """The phrases that a full-text query looks for, any of them."""
    tokens = tokenize_text(query)
    return [t for t in tokens if t not in QUERY_STOPWORDS] or tokens


def match_expression(query: str) -> str:
    return " OR ".join('"' + t.replace('"', '""') + '"' for t in query_terms(query))


@F.pandas_udf(ArrayType(StringType()))
def _tokenize(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    known: dict[str, list[str]] = {}

    def tokens(text: str | None):
        if text is None:
            return None
        found = []
        for raw in dict.fromkeys(_TOKEN.findall(text)):
            forms = known.get(raw)
            if forms is None:
                if len(known) > 200_000:
                    known.clear()
                forms = known[raw] = expand(raw)
            found.append(forms)
        return list(dict.fromkeys(chain.from_iterable(found)))

    for series in texts:
        yield series.map(tokens, na_action=None)


def tokenize(text: Column) -> Column:
    """Distinct tokens of a text column, by the Arrow form."""
    return _tokenize(text)


def tokenize_native(text: Column) -> Column:
    """The same tokens by built-in expressions."""

    def forms(raw: Column) -> Column:
        parts = F.filter(F.split(raw, SEPARATORS), lambda p: p != "")
        words = F.transform(F.flatten(F.transform(parts, lambda p: F.filter(F.split(p, CASE_BORDER), lambda w: w != ""))), F.lower)
        by_part = F.flatten(F.transform(parts, lambda p: F.concat(F.array(F.lower(p)), F.transform(F.filter(F.split(p, CASE_BORDER), lambda w: w != ""), F.lower))))
        joined = F.when(F.size(words) > 1, F.array(F.array_join(words, ""))).otherwise(F.array().cast("array<string>"))
        return F.concat(F.array(F.lower(raw)), by_part, joined)

    raws = F.array_distinct(F.filter(F.split(text, NOT_TOKEN), lambda r: r != ""))
    return F.array_distinct(F.flatten(F.transform(raws, forms)))


def token_column(text: Column) -> Column:
    return F.array_join(tokenize(text), " ")


def normalize_name(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "[^a-z0-9]", "")


def identifiers(text: Column) -> Column:
    """Distinct lower-cased identifiers of 4 to 80 characters: mixed case, an
    underscore, a dot, or capitals and digits only."""
    raw = F.split(text, NOT_TOKEN)

    def looks(r: Column) -> Column:
        shape = r.rlike("[a-z][A-Z]") | r.contains("_") | r.contains(".") | r.rlike("^[A-Z0-9_]+$")
        return F.length(r).between(4, 80) & shape

    return F.array_distinct(F.transform(F.filter(raw, looks), F.lower))


def _folds() -> tuple[str, str]:
    """Letters with a diacritic and their base letters, by decomposition."""
    pairs = []
    for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]):
        base = "".join(x for x in unicodedata.normalize("NFD", c) if not unicodedata.combining(x))
        if base != c and len(base) == 1:
            pairs.append((c, base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


FOLD_FROM, FOLD_TO = _folds()


def folded(text: Column) -> Column:
    """Lower case without diacritics."""
    return F.lower(F.translate(text, FOLD_FROM, FOLD_TO))


def fold_text(text: str) -> str:
    return text.translate(str.maketrans(FOLD_FROM, FOLD_TO)).lower()


#: Full-text tokens are runs of letters, digits and private-use characters.
WORD_BREAK = r"[^\p{L}\p{N}\p{Co}]+"


def fts_words(text: Column) -> Column:
    """Full-text tokens of a column, in order, repeats included."""
    return F.filter(F.split(folded(text), WORD_BREAK), lambda w: w != "")


def fts_words_of(text: str) -> list[str]:
    out, word = [], []
    for c in fold_text(text) + " ":
        if unicodedata.category(c)[0] in "LN" or unicodedata.category(c) == "Co":
            word.append(c)
        elif word:
            out.append("".join(word))
            word = []
    return out


_ASCII_WORD, _LETTERS = re.compile("[a-z0-9]+"), re.compile(r"[^\W_]+")
_PRIVATE = "\ue000-\uf8ff\U000f0000-\U000ffffd\U00100000-\U0010fffd"
_ANY_PRIVATE, _ANY_WORD = re.compile(f"[{_PRIVATE}]"), re.compile(rf"(?:[^\W_]|[{_PRIVATE}])+")
_FOLDS = str.maketrans(FOLD_FROM, FOLD_TO)


def fast_words(text: str) -> list[str]:
    """``fts_words_of`` by one regular expression."""
    if not text.isascii():
        text = text.translate(_FOLDS)
    text = text.lower()
    if text.isascii():
        return _ASCII_WORD.findall(text)
    return (_ANY_WORD if _ANY_PRIVATE.search(text) else _LETTERS).findall(text)


class TokenWords:
    """Full-text words of the distinct tokens of texts.  Raw tokens of several
    words are known once they are seen; a plain one is its own only form."""

    def __init__(self, most: int = 200_000):
        self.most, self.known = most, {}

    def __call__(self, text: str) -> list[str]:
        if len(self.known) > self.most:
            self.known.clear()
        known, found = self.known, {}
        for raw in dict.fromkeys(_TOKEN.findall(text)):
            low = raw.lower()
            if raw.isalnum() and raw[1:] == low[1:]:
                if low not in found:
                    found[low] = (low,)
                continue
            own = known.get(raw)
            if own is None:
                own = known[raw] = {form: _ASCII_WORD.findall(form) for form in expand(raw)}
            for form, words in own.items():
                if form not in found:
                    found[form] = words
        return list(chain.from_iterable(found.values()))


_SHAPE = re.compile(r"[a-z][A-Z]|_|\.|^[A-Z0-9_]+$")


@F.pandas_udf(ArrayType(StringType()))
def identifiers_local(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """``identifiers`` by the Arrow form, for whole corpora."""
    for series in texts:
        yield series.map(lambda t: list(dict.fromkeys(r.lower() for r in dict.fromkeys(_TOKEN.findall(t)) if 4 <= len(r) <= 80 and _SHAPE.search(r))), na_action="ignore")


def short_hash(value: Column) -> Column:
    """First 32 hex characters of SHA-256."""
    return F.substring(F.sha2(value, 256), 1, 32)


def content_hash(header: Column, body: Column) -> Column:
    return short_hash(F.concat(header, F.lit("\n---\n"), body))


def span_id(content: Column, path: Column, start: Column, end: Column) -> Column:
    key = F.concat_ws(":", content, path, start.cast("string"), end.cast("string"))
    return F.concat(F.lit("sp_"), F.substring(F.sha2(key, 256), 1, 12))


def token_estimate(text: Column) -> Column:
    return F.ceil(F.length(text) / 4).cast("int")


def line_slice(text: Column, start: Column, end: Column) -> Column:
    """Lines start to end (from 1, inclusive), clamped to the text; a missing
    text gives the empty string."""
    lines = F.split(text, "\n")
    first = F.greatest(start, F.lit(1))
    return F.coalesce(F.array_join(F.slice(lines, first, F.greatest(end - first + 1, F.lit(0))), "\n"), F.lit(""))


# File extensions of the languages that have a parser.
EXTENSIONS = {
    ".ts": "typescript", ".mts": "typescript", ".cts": "typescript", ".tsx": "tsx", ".js": "javascript", ".mjs": "javascript",
    ".cjs": "javascript", ".jsx": "javascript", ".py": "python", ".pyi": "python", ".go": "go", ".rs": "rust",
}


def detect_lang(path: Column) -> Column:
    """Language by the last extension, any case; null if there is none."""
    table = F.create_map(*(F.lit(x) for pair in EXTENSIONS.items() for x in pair))
    return F.try_element_at(table, F.lower(F.regexp_extract(path, r"(\.[^.]*)$", 1)))


def lang_of(path: str) -> str | None:
    dot = path.rfind(".")
    return EXTENSIONS.get(path[dot:].lower()) if dot >= 0 else None


def module_of(path: Column) -> Column:
    """Name of the directory that holds the file; null at the top."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.nullif(F.element_at(parts, -2), F.lit("")))


def header(path: Column, lang: Column, parent: Column | None = None, signature: Column | None = None, doc: Column | None = None) -> Column:
    """The lines that say what a chunk is and where it lives."""

    def line(name: str, value: Column | None) -> Column:
        return F.lit(None).cast("string") if value is None else F.concat(F.lit(f"{name}: "), value)

    if signature is not None and parent is not None:
        parent = F.when(signature.isNotNull(), F.nullif(parent, F.lit("")))
    if doc is not None:
        doc = F.when(F.lit(True) if signature is None else signature.isNotNull(), F.nullif(F.substring(F.regexp_replace(doc, r"\s+", " "), 1, 300), F.lit("")))
    return F.concat_ws("\n", line("file", path), line("module", module_of(path)), line("enclosing", parent), line("signature", signature), line("doc", doc), line("lang", lang))


_GLOB = re.compile(r"[*?\[]")


def glob_regex(pattern: str) -> str:
    """A regular expression for a whole value that a glob matches: ``*`` and
    ``?`` cross slashes, ``[...]`` is a class, ``[^...]`` its complement."""
    out, i = ["(?s)^"], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[" and (close := pattern.find("]", i + 2)) > 0:
            inside = pattern[i + 1 : close]
            negate = inside.startswith("^")
            out.append("[" + "^" * negate + re.sub(r"([\\\[\]&^])", r"\\\1", inside[negate:]) + "]")
            i = close
        else:
            out.append(re.sub(r"([^\w\s])", r"\\\1", c))
        i += 1
    return "".join([*out, "$"])


def in_scope(path: Column, scope: str | None) -> Column:
    """Paths that start with a scope, in which glob characters stay live."""
    if not scope:
        return F.lit(True)
    return path.rlike(glob_regex(scope + "*")) if _GLOB.search(scope) else path.startswith(scope)


def under(path: Column, root: str) -> Column:
    """The file itself, or anything below it as a directory."""
    folder = root[:-1] if root.endswith("/") else root
    return (path == root) | path.startswith(folder + "/")


def like(value: Column, pattern: str) -> Column:
    """ASCII-insensitive LIKE in which ``%`` and ``_`` are live and a backslash
    is an ordinary character."""
    return value.ilike(pattern.replace("\\", "\\\\"))


def with_idents(chunks: DataFrame, body: str = "body") -> DataFrame:
    return chunks.withColumn("idents", F.array_join(identifiers(F.col(body)), " "))
