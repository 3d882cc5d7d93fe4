"""Text functions as native column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

STOP_WORDS = {
    "python": "def class return pass import from as if else elif for while try except finally with yield lambda global nonlocal del assert raise break continue and or not in is none true false",
    "typescript": "function class return let const var import export interface type new extends implements",
    "java": "public private protected static final class return new extends implements package import void",
}
#: A run of capitals before a capitalised word or at the end, a word, a number, or any other letters.
PARTS = r"[A-Z]+(?=[A-Z][a-z]|(?![\p{L}\p{N}]))|[A-Z]?[a-z]+|[0-9]+|[\p{L}\p{No}\p{Nl}]+"
WORD = r"[\p{L}\p{N}_]+"
#: A word that is one part at most: all of it is one of PARTS, digits of other scripts aside, which are in no part.
_ODD, _OTHER = r"[\p{Nd}&&[^0-9]]", r"[\p{L}\p{No}\p{Nl}&&[^a-zA-Z]]"
_SINGLE = rf"{_ODD}*(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]+|[A-Z]*{_OTHER}[\p{{L}}\p{{No}}\p{{Nl}}]*)?{_ODD}*"
#: Identifiers of several parts or with an underscore; one expression over the text is far cheaper than one for each word.
COMPOUND = rf"(?<![\p{{L}}\p{{N}}_])(?!{_SINGLE}(?![\p{{L}}\p{{N}}_])){WORD}"
OPERATORS = r"==|!=|<=|>=|:=|\*\*|//|->|[+*/%<>=!-]"


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0))


def fold(text: Column) -> Column:
    """Case folding: lower case, with sharp s written out, and final sigma and long s as the letters they are."""
    return F.replace(F.translate(F.lower(text), "ςſ", "σs"), F.lit("ß"), F.lit("ss"))


def _folded(tokens: Column) -> Column:
    """Each token folded; all at once, as one text, since tokens hold no blanks."""
    return F.when(F.size(tokens) > 0, F.split(fold(F.array_join(tokens, " ")), " ")).otherwise(F.array().cast("array<string>"))


def tokenize(text: Column) -> Column:
    """Folded parts of words: snake case, camel case, acronyms and numbers come apart."""
    return _folded(_all(text, PARTS))


def identifier_tokens(text: Column) -> Column:
    """The parts, and whole identifiers that have more than one."""
    return _folded(F.concat(_all(text, PARTS), _all(text, COMPOUND)))


def code_tokens(text: Column, language: str = "python") -> Column:
    """Identifier tokens without the language's key words, then operator signs."""
    stop = STOP_WORDS.get(language, "").split()
    found = identifier_tokens(text)
    return F.concat(F.filter(found, lambda t: ~t.isin(*stop)) if stop else found, _all(text, OPERATORS))


def plain_query(text: str) -> str:
    return " ".join(unicodedata.normalize("NFKC", text).split()).casefold()


def normalize_query(text: Column | str) -> Column:
    """NFKC, single blanks, case folding; Spark has no normal forms of its own, so this is a pandas UDF."""

    @F.pandas_udf("string")
    def fold_all(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else plain_query(t))

    return fold_all(text)


def occurrences(text: Column, part: Column) -> Column:
    """Non-overlapping occurrences of a part."""
    n = F.length(part)
    return F.when(n > 0, (F.length(text) - F.length(F.replace(text, part, F.lit("")))) / n).otherwise(0).cast("long")


def grep_score(text: Column, query_words: Column) -> Column:
    """Occurrences of all query words in the folded text."""
    folded = fold(text)
    return F.aggregate(query_words, F.lit(0).cast("long"), lambda s, w: s + occurrences(folded, w))


def normalize_answer(text: Column) -> Column:
    """Lower case without punctuation and articles, single blanks. Articles are whole words of letters and digits of any script."""
    bare = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")
    return F.array_join(F.filter(F.split(bare, " "), lambda w: ~w.isin("", "a", "an", "the")), " ")


def contains_answer(text: Column, answer: Column) -> Column:
    return F.contains(normalize_answer(text), normalize_answer(answer)) & (normalize_answer(answer) != "")


def abstains(text: Column) -> Column:
    return F.rlike(F.lower(text), F.lit(r"\b(not (mentioned|available|provided|enough|known)|no (information|mention|record)|do(es)? ?n.?t know|cannot (answer|determine)|unknown)\b"))


def parse_time(text: Column) -> Column:
    """`2024/05/01 (Wed) 13:30` or an ISO time, UTC unless it says otherwise."""
    clean = F.regexp_replace(F.btrim(text), r"^(\d{4})/(\d{2})/(\d{2})\s*\(\w+\)\s*(\d{2}:\d{2})$", "$1-$2-$3 $4:00")
    return F.try_to_timestamp(clean)


def valid_branch(name: Column) -> Column:
    """Names that a ref may have."""
    return (name != "") & ~F.rlike(name, F.lit(r"[\s~^:?*\[\\]|\.\.|@\{|^[./]|/$|\.lock$|\.$"))


def line_of_offset(text: Column, offset: Column) -> Column:
    """0-based row of a character offset."""
    head = F.substring(text, F.lit(1), offset)
    return F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit("")))


def point_of_byte(content: Column, offset: Column) -> Column:
    """0-based (row, column) of a byte offset in a binary, the column in bytes. Each byte is looked at as one Latin-1 letter."""
    head = F.decode(F.substring(content, F.lit(1), offset), "ISO-8859-1")
    row = F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit("")))
    return F.struct(row.cast("int").alias("row"), F.length(F.substring_index(head, "\n", -1)).alias("column"))
