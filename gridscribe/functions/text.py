"""Keys, tokens and sizes of cell texts.

The tokenizer is pluggable: anything with the property size(a + sep + b) == size(a) + 1 + size(b) will do. The default is a
regular expression that runs inside the JVM.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A tokenizer is what counts the tokens of a column of texts; it may be a Pandas UDF over a vocabulary.
Sizer = Callable[[Column], Column]

#: Special marks, runs of letters and digits, or one other character; over lower-cased text.
TOKEN = r"\[sep\]|\[[ec][0-9]+\]|[\p{L}\p{M}\p{N}]+|[^\s\p{L}\p{M}\p{N}]"
#: Limits of the encoder's window, in tokens.
WINDOW, TITLE_MAX, HEADER_MAX, CELL_MAX, HEADER_SHARE = 505, 60, 30, 30, 0.1


def strip(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")


def cell_key(text: Column) -> Column:
    """Equality key of cells: stripped and lower-cased."""
    return F.lower(strip(text))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), 0)


def token_size(text: Column) -> Column:
    return F.size(tokens(text))


def truncated(text: Column, most: int, size: Sizer = token_size) -> tuple[Column, Column]:
    """(text, size): texts of `most` tokens or more become their first tokens, joined by blanks; size: another tokenizer's count."""
    n = size(text)
    return F.when(n >= most, F.array_join(F.slice(tokens(text), 1, most), " ")).otherwise(text), F.least(n, F.lit(most))


def wrap_text(text: Column) -> tuple[Column, Column]:
    """(text, size): a text of more than one word in quotes, which count as two tokens."""
    several = F.size(F.split(strip(text), r"\s+")) > 1
    return F.when(several, F.concat(F.lit("'"), text, F.lit("'"))).otherwise(text), token_size(text) + several.cast("int") * 2


def infer_type(text: Column) -> Column:
    """BOOL, INT, FLOAT, POLYGON or null, tested in this order. A signed number is an INT whatever follows its first digit."""
    t = strip(text)
    polygon = F.regexp_replace(t, '^"|"$', "").rlike(r"(?i)^multipolygon[(), .0-9]*$")
    return F.when(F.lower(t).isin("true", "false", "t", "f"), "BOOL").when(t.rlike(r"^[+-][0-9]|^[0-9]+$"), "INT").when(t.rlike(r"^-?[0-9]+\.[0-9]+$"), "FLOAT").when(polygon, "POLYGON")


def hash_slot(key: Column, n: Column) -> Column:
    """SHA-256 of the key as a number, mod n (n below 2**31): folded over its eight 32-bit words."""
    word = lambda i: F.conv(F.substring(F.sha2(key, 256), i * 8 + 1, F.lit(8)), 16, 10).cast("long")
    return F.aggregate(F.sequence(F.lit(0), F.lit(7)), F.lit(0).cast("long"), lambda a, i: (a * F.lit(4294967296) + word(i)) % n)


def coded_cost(x: Column, y: Column) -> Column:
    """Tokens of y occurrences of a text of x tokens in one window: plain, or coded with its reference."""
    return F.least(y * x, y + x + 3)


def column_letters(n: Column) -> Column:
    """Spreadsheet letters of column n (bijective base 26): 1 is A, 27 is AA; below 1 the empty text; up to 7 letters."""
    places = []
    for i in range(6, -1, -1):
        least = sum(26**j for j in range(i + 1))  # the first n of i + 1 letters
        places.append(F.when(n >= least, F.char(F.floor((n - least) / 26**i) % 26 + 65)).otherwise(""))
    return F.concat(*places)


def next_prime(n: int) -> int:
    """The least prime not below n."""
    n = max(2, n)
    while any(n % d == 0 for d in range(2, int(n**0.5) + 1)):
        n += 1
    return n


# ---- the same for DuckDB --------------------------------------------------------------------------------------------------------


def sql_strip(e: str) -> str:
    return rf"regexp_replace(coalesce({e}, ''), '^\s+|\s+$', '', 'g')"


def sql_key(e: str) -> str:
    return f"lower({sql_strip(e)})"


def sql_tokens(e: str) -> str:
    return f"regexp_extract_all(lower({e}), '{TOKEN}')"


def sql_size(e: str) -> str:
    return f"len({sql_tokens(e)})"


def sql_truncated(e: str, most: int) -> str:
    return f"CASE WHEN {sql_size(e)} >= {most} THEN array_to_string({sql_tokens(e)}[1:{most}], ' ') ELSE {e} END"


def sql_type(e: str) -> str:
    t = sql_strip(e)
    return rf"""CASE WHEN lower({t}) IN ('true', 'false', 't', 'f') THEN 'BOOL' WHEN regexp_matches({t}, '^[+-][0-9]|^[0-9]+$') THEN 'INT'
      WHEN regexp_matches({t}, '^-?[0-9]+\.[0-9]+$') THEN 'FLOAT' WHEN regexp_matches(regexp_replace({t}, '^"|"$', '', 'g'), '(?i)^multipolygon[(), .0-9]*$') THEN 'POLYGON' END"""


def sql_slot(key: str, n: str) -> str:
    return f"list_reduce([('0x' || substr(sha256({key}), i * 8 + 1, 8))::BIGINT FOR i IN range(0, 8)], lambda a, x: (a * 4294967296 + x) % {n}, 0::BIGINT)"
