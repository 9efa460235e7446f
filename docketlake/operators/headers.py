"""Column headers -> canonical fields.

The whole match is a column expression over an ``ARRAY<STRING>`` of headers: the
vocabulary is a literal, so scoring needs no join and no shuffle, and a table row
can be tested for being a header where it lies.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketlake import vocab
from docketlake.functions.text import _col, let

OVERRIDE_SCORE = 999
_EXACT_SCORE = 100


def _base(header: Column) -> Column:
    low = F.lower(F.trim(F.coalesce(header, F.lit(""))))
    return F.regexp_replace(F.replace(low, F.lit("&"), F.lit("and")), r"\([^)]*\)", " ")


def normalize_header(header: Column | str) -> Column:
    """Comparable key of a header: letters and digits only."""
    header = _col(header)
    key = F.regexp_replace(_base(header), r"[^a-z0-9]+", "")
    unnamed = F.lower(F.trim(header)).startswith("unnamed:")
    return F.when(F.coalesce(unnamed, F.lit(False)), F.lit("")).otherwise(key)


def header_tokens(header: Column | str) -> Column:
    """Words of a header in lower case."""
    words = F.split(_base(_col(header)), r"[^a-z0-9]+")
    return F.filter(words, lambda w: w != "")


def _shared_prefixes(words: Iterable[str]) -> str:
    """Regex of a word list with common beginnings written once; prefers long words."""
    tails: dict[str, list[str]] = {}
    words = set(words)
    for word in sorted(words - {""}):
        tails.setdefault(word[0], []).append(word[1:])
    options = "|".join(first + _shared_prefixes(rest) for first, rest in tails.items())
    if "" in words:
        return f"(?:{options})?" if options else ""
    return f"(?:{options})" if len(tails) > 1 else options


def _longest_first(phrases: Iterable[str]) -> str:
    """Regex that finds, at every position, the longest phrase starting there."""
    return f"(?=({_shared_prefixes(phrases)}))"


def _prefix_table(synonyms: Mapping[str, Sequence[str]]) -> Column:
    """``MAP<phrase, ARRAY<STRUCT<field, phrase>>>``: all phrases a phrase begins with.

    Whatever else starts where the longest phrase was found is a beginning of it.
    """
    pairs = [(f, s) for f, items in synonyms.items() for s in items]

    def heads(phrase: str) -> str:
        rows = (f"named_struct('field','{f}','phrase','{s}')" for f, s in pairs if phrase.startswith(s))
        return f"array({','.join(rows)})"

    return F.expr("map(" + ",".join(f"'{p}',{heads(p)}" for p in dict.fromkeys(s for _, s in pairs)) + ")")


def _rule_table(rules: Mapping[str, Sequence[tuple[Sequence[str], int]]]) -> Column:
    """``MAP<word, ARRAY<STRUCT<field, needed, weight>>>``: the rules by the first word they need."""
    by_word: dict[str, list[str]] = {}
    for field, items in rules.items():
        for needed, weight in items:
            by_word.setdefault(needed[0], []).append(
                f"named_struct('field','{field}','needed',split('{' '.join(needed)}',' '),'weight',{weight})")
    return F.expr("map(" + ",".join(f"'{word}',array({','.join(rows)})" for word, rows in by_word.items()) + ")")


def _field_table(fields: Sequence[str]) -> Column:
    # Equal scores of one column are tried in descending field-name order.
    names = sorted(fields, reverse=True)
    rows = (f"named_struct('rank',{i},'field','{f}')" for i, f in enumerate(names))
    return F.expr(f"array({','.join(rows)})")


def _stems(
    synonyms: Mapping[str, Sequence[str]], rules: Mapping[str, Sequence[tuple[Sequence[str], int]]]
) -> str:
    """Regex of the shortest texts one of which every scoring header contains."""
    texts = {s for group in synonyms.values() for s in group}
    texts |= {word for group in rules.values() for needed, _ in group for word in needed}
    short = [t for t in texts if not any(o != t and o in t for o in texts)]
    return _shared_prefixes(short)


def hinted_cells(cells: Column) -> Column:
    """Number of cells that hold any vocabulary stem: a cheap bound on the number that would map."""
    stems = _stems(vocab.SYNONYMS, vocab.TOKEN_RULES)
    return F.size(F.filter(cells, lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]+", "").rlike(stems)))


def may_name_fields(cells: Column) -> Column:
    """False only for rows of which no cell maps to a field: one look at the joined row.

    A parenthesis, whose content headers leave out, always passes.
    """
    stems = _stems(vocab.SYNONYMS, vocab.TOKEN_RULES)

    def holds(row: Column) -> Column:
        text = F.regexp_replace(F.replace(F.lower(row), F.lit("&"), F.lit("and")), "[^a-z0-9]+", "")
        return row.contains("(") | text.rlike(stems)

    return let(F.array_join(cells, " "), holds)


def header_scores(
    header: Column | str,
    synonyms: Mapping[str, Sequence[str]] = vocab.SYNONYMS,
    rules: Mapping[str, Sequence[tuple[Sequence[str], int]]] = vocab.TOKEN_RULES,
) -> Column:
    """``ARRAY<STRUCT<score, rank, field>>`` of the fields a header may name."""
    fields = _field_table(sorted(set(synonyms) | set(rules)))

    def phrase_score(norm: Column, h: Column) -> Column:
        return F.when(norm == h["phrase"], F.lit(_EXACT_SCORE)).otherwise(F.length(h["phrase"]) + 40)

    def scored(norm: Column, tokens: Column) -> Column:
        found = F.regexp_extract_all(norm, F.lit(_longest_first(s for v in synonyms.values() for s in v)), 1)
        phrases = F.filter(
            F.flatten(F.transform(F.array_distinct(found), lambda p: F.element_at(_prefix_table(synonyms), p))),
            lambda h: (F.length(h["phrase"]) >= 6) | (norm == h["phrase"]),
        )
        started = F.transform(F.array_distinct(tokens), lambda w: F.element_at(_rule_table(rules), w))
        met = F.filter(
            F.flatten(F.filter(started, lambda rs: rs.isNotNull())),
            lambda r: F.forall(r["needed"], lambda w: F.array_contains(tokens, w)),
        )

        def of_field(f: Column, phrases: Column, met: Column) -> Column:
            named = F.aggregate(
                F.filter(phrases, lambda h: h["field"] == f["field"]), F.lit(0),
                lambda best, h: F.greatest(best, phrase_score(norm, h)),
            )
            hinted = F.aggregate(
                F.filter(met, lambda r: r["field"] == f["field"]), F.lit(0), lambda n, r: n + r["weight"]
            )
            return F.struct(F.greatest(named, hinted).alias("score"), f["rank"].alias("rank"), f["field"].alias("field"))

        def of_fields(ps: Column, ms: Column) -> Column:
            # Few fields are named or hinted at all; only those are scored.
            held = F.concat(F.transform(ps, lambda h: h["field"]), F.transform(ms, lambda r: r["field"]))
            return let(held, lambda names: F.transform(
                F.filter(fields, lambda f: F.array_contains(names, f["field"])), lambda f: of_field(f, ps, ms)))

        return let(phrases, lambda ps: let(met, lambda ms: of_fields(ps, ms)))

    header = _col(header)
    none = F.array().cast("array<struct<score:int,rank:int,field:string>>")
    # Data cells rarely hold any vocabulary stem, so they stop at one regex.
    return let(
        normalize_header(header),
        lambda norm: F.when(
            norm.rlike(_stems(synonyms, rules)),
            let(
                header_tokens(header),
                lambda tokens: F.filter(scored(norm, tokens), lambda s: s["score"] > 0),
            ),
        ).otherwise(none),
    )


def map_headers(
    headers: Column | str,
    overrides: Mapping[str, str] | None = None,
    min_score: int = vocab.MIN_HEADER_SCORE,
) -> Column:
    """One-to-one assignment: ``ARRAY<STRUCT<col INT, field STRING, score INT>>``.

    Candidates are taken greedily by score, then position, then field name
    descending; every column and every field is used once.
    """
    overrides = overrides or {}

    def candidates(header: Column, ix: Column) -> Column:
        def ranked(s: Column) -> Column:
            return F.struct(
                (-s["score"]).alias("neg"), ix.alias("col"), s["rank"].alias("rank"), s["field"].alias("field")
            )

        scored = F.transform(
            F.filter(header_scores(header), lambda s: s["score"] >= min_score), ranked
        )
        if not overrides:
            return scored
        norm = normalize_header(header)
        forced = F.array().cast("array<struct<neg:int,col:int,rank:int,field:string>>")
        out = None
        for raw, field in overrides.items():
            key = "".join(ch for ch in raw.lower().replace("&", "and") if ch.isascii() and ch.isalnum())
            row = F.array(F.struct(
                F.lit(-OVERRIDE_SCORE).alias("neg"), ix.alias("col"),
                F.lit(0).alias("rank"), F.lit(field).alias("field"),
            ))
            out = (out or F).when(norm == key, row)
        return out.otherwise(scored) if out is not None else F.concat(forced, scored)

    ordered = F.sort_array(F.flatten(F.transform(_col(headers), candidates)))
    empty = F.array().cast("array<struct<col:int,field:string,score:int>>")
    return F.aggregate(
        ordered,
        empty,
        lambda taken, c: F.when(
            F.exists(taken, lambda t: (t["col"] == c["col"]) | (t["field"] == c["field"])), taken
        ).otherwise(
            F.concat(
                taken,
                F.array(F.struct(
                    c["col"].alias("col"), c["field"].alias("field"), (-c["neg"]).alias("score")
                )),
            )
        ),
    )


def mapped_fields(mapping: Column | str) -> Column:
    """Sorted field names of a mapping; its signature."""
    return F.sort_array(F.transform(_col(mapping), lambda m: m["field"]))


def name_headers(cells: Column | str) -> Column:
    """Blank headers become ``column_i``; repeats become ``name__1``, ``name__2``."""
    filled = F.transform(
        _col(cells),
        lambda h, i: F.coalesce(
            F.nullif(F.trim(h), F.lit("")), F.concat(F.lit("column_"), i.cast("string"))
        ),
    )
    return let(
        filled,
        lambda names: F.transform(
            names,
            lambda n, i: let(
                F.size(F.filter(F.slice(names, 1, i), lambda x: x == n)),
                lambda k: F.when(k > 0, F.concat(n, F.lit("__"), k.cast("string"))).otherwise(n),
            ),
        ),
    )


def mapping_report(frames: DataFrame, headers: str = "headers", mapping: str = "mapping") -> DataFrame:
    """One row per header: the field it fills, or NULL when unused."""
    keys = [c for c in frames.columns if c not in (headers, mapping)]
    return frames.select(*keys, F.posexplode(headers).alias("col_ix", "header"), mapping).select(
        *keys,
        "col_ix",
        "header",
        F.get(
            F.transform(
                F.filter(mapping, lambda m: m["col"] == F.col("col_ix")), lambda m: m["field"]
            ),
            F.lit(0),
        ).alias("field"),
    )
