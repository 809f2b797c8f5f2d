"""Cells that pack several values behind inconsistent delimiters, parsed by a small expression grammar.

    cell      <- blank* value (delimiter value)* blank*
    value     <- quoted &(blank* (delimiter / end)) / bare
    quoted    <- '"' ('""' / !'"' .)* '"'  /  '“' (!'”' .)* '”'
    bare      <- (guarded / bracketed / !delimiter .)*
    bracketed <- '(' (!')' .)* ')'
    guarded   <- what the profile never cuts: d/b/a, n/a, a comma before a legal form, a joiner inside a listed name
    delimiter <- profile's signs / profile's joining words between blanks

Alternatives are ordered; a quote or bracket that never closes is backtracked and read as plain text with the error flag.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Legal forms that may follow a firm's name after a comma.
LEGAL_FORMS = (
    "incorporated", "inc", "corporation", "corp", "company", "co", "limited liability", "limited", "ltd", "l.l.c", "llc",
    "l.l.p", "llp", "lp", "plc", "p.l.c", "gmbh", "g.m.b.h", "ag", "s.a", "sa", "s.p.a", "spa", "s.r.l", "srl", "b.v", "bv",
    "pty", "pvt", "kg", "oy", "ab", "a.s", "s.a.s", "sas",
)

JOINED = r"\s+(?:and|or|&)\s+"  # what joins the parts of one name

_WORD = re.compile(r"\w[\w'’.\-]*")
_BLANK = re.compile(r"\s*")
_LEGAL = r",\s*(?:" + "|".join(re.escape(x) for x in sorted(LEGAL_FORMS, key=len, reverse=True)) + r")(?![\w])\.?"


@dataclass(frozen=True)
class Profile:
    """How cells of one kind are cut: delimiter signs, joining words that also cut, and what is never cut."""

    signs: str = ";|/,\n\r\t"
    joiners: tuple[str, ...] = ()
    legal: bool = False
    names: tuple[str, ...] = ()

    def suspicious(self) -> str:
        """The pattern without which a cell holds one plain value: its signs, joining words, quotes and brackets."""
        words = "|".join(re.escape(w) for w in self.joiners)
        return "[" + re.escape(self.signs) + "\"“”()]" + (rf"|(?i)\s(?:{words})\s" if words else "")

    def compiled(self) -> tuple[re.Pattern, re.Pattern]:
        words = "|".join(re.escape(w) for w in self.joiners)
        comma = r",(?:\s*(?:and|or|&)(?=\s))?" if "," in self.signs else r"(?!)"
        plain = self.signs.replace(",", "")
        sign = "[" + re.escape(plain) + "]" if plain else r"(?!)"
        delimiter = rf"{sign}|{comma}" + (rf"|(?<=\s)(?:{words})(?=\s)" if words else "")
        guards = [r"(?<!\w)d/b/a(?!\w)", r"(?<!\w)n/a(?!\w)", r"(?<!\w)c/o(?!\w)"]
        if self.legal:
            guards.append(_LEGAL)
        for name in self.names:
            left, right = re.split(JOINED, name, maxsplit=1, flags=re.I)
            # the joiner stays when either neighbour begins as in the listed name, so that a slip in the other one is harmless
            join = r"\s+(?:and|or|&)(?=\s)"
            guards.append(rf"(?<!\w){re.escape(left[:4])}(?:(?!{re.escape(right[:4])})[^\s;|/,()])*{join}")
            guards.append(rf"{join}(?=\s+{re.escape(right[:4])})")
        return re.compile(delimiter, re.I), re.compile("|".join(guards), re.I)


def parse_cell(cell: str | None, delimiter: re.Pattern, guard: re.Pattern) -> list[tuple[int, str, bool]]:
    """(position, value, error) of each non-blank value of a cell; NULL and blank cells have none."""
    out: list[tuple[int, str, bool]] = []
    if not cell:
        return out
    at, end = 0, len(cell)
    while at <= end:
        at = _BLANK.match(cell, at).end()
        quoted = _quoted(cell, at, delimiter)
        if quoted is not None:
            value, at = quoted
            error = False
        else:
            start, error = at, at < end and cell[at] in '"“'
            while at < end:
                if m := guard.match(cell, at):
                    at = m.end()
                elif cell[at] == "(":
                    close = cell.find(")", at)
                    error |= close < 0
                    at = at + 1 if close < 0 else close + 1
                elif delimiter.match(cell, at):
                    break
                else:
                    word = _WORD.match(cell, at)
                    at = word.end() if word else at + 1
            value = cell[start:at].strip()
        if value.strip():
            out.append((len(out) + 1, value, error))
        if at >= end:
            break
        at = delimiter.match(cell, at).end()
    return out


def _quoted(cell: str, at: int, delimiter: re.Pattern) -> tuple[str, int] | None:
    """The value of a quoted form that starts at `at`, and where its delimiter or the end follows; else None."""
    if at >= len(cell) or cell[at] not in '"“':
        return None
    close = '"' if cell[at] == '"' else "”"
    i, parts = at + 1, []
    while i < len(cell):
        if cell[i] != close:
            parts.append(cell[i])
        elif close == '"' and cell[i + 1 : i + 2] == '"':
            parts.append('"')
            i += 1
        else:
            after = i + 1 + len(cell[i + 1 :]) - len(cell[i + 1 :].lstrip(" "))
            if after >= len(cell) or delimiter.match(cell, after):
                return "".join(parts).strip(), after
            return None
        i += 1
    return None


def split_values(df: DataFrame, keys: list[str], fields: dict[str, Profile]) -> DataFrame:
    """One row (keys, field, position, value, n_values, error) per value of the packed cells of `fields`.

    `df` is read as given: callers reduce repeated records first. Position counts from 1 over non-blank values, of which the
    cell has `n_values`. NULL, empty and blank cells give no row. Values are trimmed and lose their enclosing quotes, a doubled quote inside being one; a
    quote or bracket that is never closed is plain text and sets `error`. Cells without any sign of their profile are answered
    in the JVM; only the others pass to the parser, in Arrow batches, and each cell is parsed whole whatever its length.
    """
    cells = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("cell")) for f in fields]))
    long = df.select(*keys, cells.alias("c")).select(*keys, "c.field", "c.cell").where(F.trim(F.regexp_replace("cell", r"\s", " ")) != "")
    hard = reduce(lambda a, b: a | b, [(F.col("field") == f) & F.col("cell").rlike(p.suspicious()) for f, p in fields.items()])
    compiled = {f: p.compiled() for f, p in fields.items()}

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, str], list[tuple[int, str, bool]]] = {}
        for b in batches:
            out = []
            for f, c in zip(b.column("field").to_pylist(), b.column("cell").to_pylist()):
                if (got := seen.get((f, c))) is None:
                    got = parse_cell(c, *compiled[f])
                    if len(seen) < 10_000:  # a bounded memo of frequent cells; results don't depend on it
                        seen[f, c] = got
                out.append(got)
            lens = [len(v) for v in out]
            take = pa.array([i for i, n in enumerate(lens) for _ in range(n)], pa.int64())
            flat = [(*v, n) for vs, n in zip(out, lens) for v in vs]
            base = b.select([*keys, "field"]).take(take)
            yield pa.RecordBatch.from_arrays(
                [*base.columns, pa.array([v[0] for v in flat], pa.int32()), pa.array([v[1] for v in flat], pa.string()), pa.array([v[3] for v in flat], pa.int32()), pa.array([v[2] for v in flat], pa.bool_())],
                names=[*keys, "field", "position", "value", "n_values", "error"],
            )

    types = dict(df.select(*keys).dtypes)
    schema = ", ".join([*(f"`{k}` {types[k]}" for k in keys), "field string, position int, value string, n_values int, error boolean"])
    parsed = long.where(hard).mapInArrow(parse, schema)
    value = F.regexp_replace("cell", r"^\s+|\s+$", "")
    plain = long.where(~hard).select(*keys, "field", F.lit(1).alias("position"), value.alias("value"), F.lit(1).alias("n_values"), F.lit(False).alias("error"))
    return parsed.unionByName(plain)
