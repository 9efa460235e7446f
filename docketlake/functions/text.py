"""Text cleaning and keys as column expressions.

ASCII values take a short path; Unicode folding only runs inside a ``when`` on
rows that hold a non-ASCII character, so the usual row never pays for it.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketlake import vocab

NON_ASCII = r"[^\x00-\x7F]"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --------------------------------------------------------------------------
# Unicode folding tables, derived from the Unicode database by rule
# --------------------------------------------------------------------------


def _code_points() -> Iterable[str]:
    for cp in range(0xA0, 0x1FFFF):
        if not 0xD800 <= cp <= 0xDFFF and not 0xAC00 <= cp <= 0xD7A3:
            yield chr(cp)


@functools.cache
def _compat_tables() -> tuple[str, str, dict[str, str], dict[str, str]]:
    """NFKC by character: 1:1 map, 1:n expansions, and base+mark compositions."""
    src, dst, expand, compose = [], [], {}, {}
    for ch in _code_points():
        out = unicodedata.normalize("NFKC", ch)
        if out != ch:
            if len(out) == 1:
                src.append(ch)
                dst.append(out)
            else:
                expand[ch] = out
            continue
        pair = unicodedata.normalize("NFD", ch)
        if len(pair) > 1 and unicodedata.normalize("NFC", pair) == ch:
            head = unicodedata.normalize("NFC", pair[:-1])
            compose[head + pair[-1]] = ch
    # Compositions onto an already composed head come after plain heads.
    ordered = dict(sorted(compose.items(), key=lambda kv: len(unicodedata.normalize("NFD", kv[1]))))
    return "".join(src), "".join(dst), expand, ordered


@functools.cache
def _key_tables() -> tuple[str, str, str, dict[str, str]]:
    """How a non-ASCII character shows up in an employer key.

    Returns 1:1 source/target strings, a character class of letters that carry a
    mark (the mark turns into a space after the letter), and 1:n expansions.
    """
    src, dst, marked, expand = [], [], [], {}
    for ch in _code_points():
        low = unicodedata.normalize("NFKD", ch).lower()
        kept = "".join(c if re.match(r"[a-z0-9/&\s]", c) and c.isascii() else " " for c in low)
        squeezed = re.sub(r" +", " ", kept)
        if not squeezed.strip():
            continue
        if len(squeezed) == 1 or (len(squeezed) == 2 and squeezed[1] == " "):
            src.append(ch)
            dst.append(squeezed[0])
            if len(squeezed) == 2:
                marked.append(ch)
        else:
            expand[ch] = squeezed
    return "".join(src), "".join(dst), _char_class(marked), expand


def _char_class(chars: list[str]) -> str:
    runs: list[list[int]] = []
    for cp in sorted(map(ord, chars)):
        if runs and cp == runs[-1][1] + 1:
            runs[-1][1] = cp
        else:
            runs.append([cp, cp])
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in runs) + "]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times inside ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _replace_all(c: Column, table: dict[str, str], touched: Callable[[Column], Column]) -> Column:
    """Apply a replacement table, but only to values that ``touched`` selects."""
    old, new = (F.split(F.lit("\x00".join(part)), "\x00") for part in (table, table.values()))
    pairs = F.arrays_zip(old.alias("old"), new.alias("new"))
    return let(
        c,
        lambda v: F.when(
            touched(v),
            F.aggregate(pairs, v, lambda acc, p: F.replace(acc, p["old"], p["new"])),
        ).otherwise(v),
    )


@F.pandas_udf(T.StringType())
def _nfkc_exact(s: pd.Series) -> pd.Series:
    return s.map(lambda v: unicodedata.normalize("NFKC", v), na_action="ignore")


def nfkc(c: Column | str) -> Column:
    """Exact NFKC.  Only non-ASCII rows carry a value into the Python worker."""
    c = _col(c)
    return F.coalesce(_nfkc_exact(F.when(c.rlike(NON_ASCII), c)), c)


def _holds(chars: str) -> Callable[[Column], Column]:
    return lambda v: F.translate(v, chars, "") != v


def fold_unicode(c: Column | str) -> Column:
    """NFKC inside the JVM: compatibility characters, expansions, base+mark pairs.

    Differs from :func:`nfkc` only for stacked marks in non-canonical order and
    for decomposed Hangul.
    """
    c = _col(c)
    src, dst, expand, compose = _compat_tables()
    text = _replace_all(F.translate(c, src, dst), expand, _holds("".join(expand)))
    text = _replace_all(text, compose, lambda v: v.rlike(r"\p{M}"))
    return F.when(c.rlike(NON_ASCII), text).otherwise(c)


# --------------------------------------------------------------------------
# Cleaning
# --------------------------------------------------------------------------


def squeeze(c: Column | str) -> Column:
    """Drop zero-width characters, collapse white space, trim."""
    visible = F.translate(_col(c), "\u200b\ufeff", "")
    return F.trim(F.regexp_replace(visible, r"(?U)[\s\x1c-\x1f]+", " "))


def clean_text(c: Column | str, max_length: int | None = None, unicode: str = "jvm") -> Column:
    """Normalised text, or NULL for a placeholder; cut only where a ``max_length`` is given.

    ``unicode``: ``jvm`` folds inside the JVM, ``exact`` goes through a vectorised
    NFKC for non-ASCII rows, ``done`` trusts an earlier normalisation.
    """
    c = _col(c).cast("string")
    if unicode == "exact":
        c = nfkc(c)
    elif unicode == "jvm":
        c = fold_unicode(c)
    text = squeeze(c)
    kept = text if max_length is None else F.substring(text, 1, max_length)
    return F.when(~F.lower(text).isin(*vocab.PLACEHOLDERS), kept)


def clean_cell(c: Column) -> Column:
    """``clean_text`` of a normalised cell, which is usually even already: one blank between printable ASCII words."""
    uneven = c.contains("  ") | c.startswith(" ") | c.endswith(" ") | c.rlike("[^ -~]")
    return F.when(uneven, clean_text(c, unicode="done")).otherwise(F.when(~F.lower(c).isin(*vocab.PLACEHOLDERS), c))


def employer_key(c: Column | str) -> Column:
    """Comparison key for company names: no marks, punctuation or legal forms."""
    c = F.coalesce(_col(c), F.lit(""))
    src, dst, marked, expand = _key_tables()
    spaced = F.regexp_replace(c, f"({marked})", "$1 ")
    folded = F.translate(_replace_all(spaced, expand, _holds("".join(expand))), src, dst)
    text = F.lower(F.when(c.rlike(NON_ASCII), folded).otherwise(c))
    text = F.regexp_replace(text, r"(?U)\b(?:d/?b/?a|f/?k/?a)\b.*$", " ")
    text = F.regexp_replace(F.replace(text, F.lit("&"), F.lit(" and ")), r"[^a-z0-9]+", " ")
    suffix = "|".join(vocab.LEGAL_SUFFIXES)
    return F.trim(F.regexp_replace(F.trim(text), rf"(?: (?:{suffix})){{1,3}}$", ""))


def clean_zip(c: Column | str, unicode: str = "jvm") -> Column:
    """First five-digit code, leading zeros kept."""
    text = clean_text(c, unicode=unicode)
    return F.nullif(F.regexp_extract(text, r"\b(\d{5})(?:-\d{4})?\b", 1), F.lit(""))


def drop_bare_code(c: Column | str) -> Column:
    """NULL for a bare 2-6 digit classification code."""
    c = _col(c)
    return F.when(~c.rlike(r"^\d{2,6}$"), c)


def split_list(c: Column | str, case: str | None = None, spaces: bool = False) -> Column:
    """Comma list -> trimmed non-empty items; ``spaces`` also splits on blanks."""
    c = F.coalesce(_col(c), F.lit(""))
    items = F.transform(F.split(c, r"[,\s]" if spaces else ","), lambda x: F.trim(x))
    if case == "upper":
        items = F.transform(items, lambda x: F.upper(x))
    elif case == "lower":
        items = F.transform(items, lambda x: F.lower(x))
    return F.filter(items, lambda x: x != "")


def state_codes(c: Column | str) -> Column:
    """Code list as typed on a command line; ``all`` or nothing means NULL."""
    c = _col(c)
    items = split_list(c, "upper", spaces=True)
    return F.when((F.size(items) > 0) & (F.lower(F.trim(c)) != "all"), items)


def thousands(c: Column | str) -> Column:
    """Display text of a count; NULL shows as a dash."""
    return F.coalesce(F.format_number(_col(c), 0), F.lit("—"))
