"""Fill-in-the-middle by lookaround splitting.

A unit grammar says in which order classes of characters follow one another inside a unit.
A unit ends exactly where the order starts anew, which two neighbouring characters show; so the
grammar becomes a zero-width regex of neighbouring classes, and ``split`` at it keeps every
character.  An empty text, which ``split`` would turn into one empty piece, has no unit.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import free_names, packed_rows, text_or_empty

#: Blanks as the contract has them.
_BLANK = r"\x20\x09-\x0D"


@dataclass(frozen=True)
class Part:
    """A class of characters (the body of a bracket expression), once or many times in a row."""

    chars: str
    many: bool = True


@dataclass(frozen=True)
class Grammar:
    """Units made of ``parts`` in this order; each may be missing, but not all.

    The parts' classes must share out all characters among them.
    """

    parts: tuple[Part, ...]

    def regex(self) -> str:
        """What matches one unit, left to right."""
        return r"(?=[\s\S])" + "".join(f"[{p.chars}]{'*' if p.many else '?'}" for p in self.parts)

    def boundary(self) -> str:
        """The zero-width regex of the places between units: after a part, before one that cannot follow it in a unit."""
        cuts = []
        for i, part in enumerate(self.parts):
            nexts = [p.chars for k, p in enumerate(self.parts) if k < i or k == i and not p.many]
            if nexts:
                cuts.append(f"(?<=[{part.chars}])(?=" + "|".join(f"[{c}]" for c in nexts) + ")")
        return "|".join(cuts)


#: A word with the blanks before it; blanks at the end are a unit of their own.
TOKENS = Grammar((Part(_BLANK), Part("^" + _BLANK)))
#: A word with the blanks after it.
WORDS = Grammar((Part("^" + _BLANK), Part(_BLANK)))
#: A line with its line feed.
LINES = Grammar((Part(r"^\n"), Part(r"\n", many=False)))
#: A single code point.
CHARACTERS = Grammar((Part(r"\s\S", many=False),))


def units(text: Column, grammar: Grammar = TOKENS) -> Column:
    """The units of a text, which joined give it back; none for an empty or null one."""
    none = F.array().cast("array<string>")
    cut = grammar.boundary()
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, none).otherwise(F.split(text, cut, -1) if cut else F.array(text))


@dataclass(frozen=True)
class Marks:
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"


def fill_in_middle(
    docs: DataFrame, grammar: Grammar = TOKENS, seed: int = 42, percent: int = 50, suffix_first_percent: int = 80, marks: Marks = Marks(),
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """docs with ``n, form, prefix_chars, middle_chars, output``, names changed by underscores where docs has them.

    The seed and a row's id draw two cuts among its ``n`` units, whether it is transformed at all (``percent``), and in which
    order the parts stand (``psm``, or ``spm`` in ``suffix_first_percent`` of cases).  Texts that are empty, null or hold a mark stay as they are
    (``plain``, output is the text, empty for null), so ``restored`` finds the marks where they were put.

    A row's result depends on its own id and text only: nothing is shuffled.  A null id draws as an empty one; repeated rows give
    repeated results; an empty table gives none; long texts are cut whole; other columns are kept.
    """
    row, pieces, h, lo, hi, form = free_names(docs, "row", "pieces", "h", "lo", "hi", "form_")
    text = text_or_empty(F.col(f"{row}.{text_col}"))
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"{row}.{id_col}").cast("string"), F.lit(""))), 256)
    part = [F.conv(F.substring(F.col(h), 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]
    marked = F.lit(False)
    for mark in (marks.prefix, marks.suffix, marks.middle):
        marked = marked | F.contains(text, F.lit(mark))
    n = F.size(pieces).cast("long")
    plain = (F.size(pieces) == 0) | marked | (part[2] % 100 >= percent)
    cut = docs.select(packed_rows(docs).alias(row)).select(row, units(text, grammar).alias(pieces), drawn.alias(h))
    first, second = part[0] % (n + 1), part[1] % (n + 1)
    cut = cut.select(
        row, pieces, F.least(first, second).cast("int").alias(lo), F.greatest(first, second).cast("int").alias(hi),
        F.when(plain, "plain").when(part[3] % 100 < suffix_first_percent, "spm").otherwise("psm").alias(form),
    )
    join = lambda start, length: F.array_join(F.slice(pieces, start, length), "")
    three = F.struct(
        join(F.lit(1), F.col(lo)).alias("p"), join(F.col(lo) + 1, F.col(hi) - F.col(lo)).alias("m"), join(F.col(hi) + 1, F.size(pieces) - F.col(hi)).alias("s")
    )
    done = cut.select(row, form, F.size(pieces).cast("long").alias(h), F.when(F.col(form) != "plain", three).alias(pieces))
    p, m, s = (F.col(f"{pieces}.{x}") for x in "pms")
    output = (
        F.when(F.col(form) == "psm", F.concat(F.lit(marks.prefix), p, F.lit(marks.suffix), s, F.lit(marks.middle), m))
        .when(F.col(form) == "spm", F.concat(F.lit(marks.suffix), s, F.lit(marks.prefix), p, F.lit(marks.middle), m)).otherwise(text)
    )
    names = free_names(docs, "n", "form", "prefix_chars", "middle_chars", "output")
    made = [F.col(h), F.col(form), F.length(p).cast("long"), F.length(m).cast("long"), output]
    return done.select(*[F.col(f"{row}.`{c}`").alias(c) for c in docs.columns], *[x.alias(name) for x, name in zip(made, names)])


def restored(output: Column, form: Column, marks: Marks = Marks()) -> Column:
    """The text that ``output`` in this form was made of; each mark stands in it once, where it was put."""

    def between(left: str, right: str | None) -> Column:
        rest = F.substring_index(output, left, -1)
        return F.substring_index(rest, right, 1) if right else rest

    psm = F.concat(between(marks.prefix, marks.suffix), between(marks.middle, None), between(marks.suffix, marks.middle))
    spm = F.concat(between(marks.prefix, marks.middle), between(marks.middle, None), between(marks.suffix, marks.prefix))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


#: Tokens by regular expression, cuts by list slices.
ORACLE = r"""
with d as (
  select doc_id, coalesce(text, '') as text, sha256('42:' || coalesce(doc_id::varchar, '')) as h,
    regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') as u from documents
), k as (
  select doc_id, text, u, len(u)::bigint as n, ('0x' || substr(h, 1, 8))::bigint % (len(u) + 1) as a, ('0x' || substr(h, 9, 8))::bigint % (len(u) + 1) as b,
    case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or ('0x' || substr(h, 17, 8))::bigint % 100 >= 50 then 'plain'
      when ('0x' || substr(h, 25, 8))::bigint % 100 < 80 then 'spm' else 'psm' end as form from d
), c as (
  select doc_id, text, n, form, array_to_string(u[1:least(a, b)], '') as p, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') as m,
    array_to_string(u[greatest(a, b) + 1:n], '') as s from k
)
select doc_id, n, form, case when form <> 'plain' then length(p)::bigint end as prefix_chars, case when form <> 'plain' then length(m)::bigint end as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256,
  sha256(text) as restored_sha256
from c
"""
