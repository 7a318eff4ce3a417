"""Fill-in-the-middle: documents cut at two units and put together with marks around the parts.

A unit is a run of the letters A-Z and a-z, or one other code point. Each text is stored as its maximal
runs of one character class, with the code point each starts at, the units before it and the code
points a unit takes there; a cut after so many units is found by binary search over the units before
runs, and its offset by multiplication. Only these offsets leave the Python worker: Spark's own
expressions cut the text and join the parts, so no text comes back from Python.

Cuts and form are drawn from the document's id: the first four groups of 8 digits of the hex sha256 of
the seed, a colon and the id. Some documents stay plain (as their text is empty, holds a mark, or by the
share of plain ones); the others are prefix, suffix, middle or (in a share of cases) suffix first. `restore`
gives back the exact text from output and form: marks share a first character that is nowhere else in
them, so that no mark arises where a part and a mark meet.

Defined results: a null or empty text is plain, of 0 units and empty output; a null id draws as an empty
one; repeated rows give repeated results; nothing is compared, so ties cannot arise; a text of any length
is one row with memory for its own runs; an empty table gives an empty table; columns of the table keep
their names, and the new ones are named by the caller, who must choose free ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tidemark.llm.common import text_or_empty, unused

SEED = 1
#: Per cent of documents that are cut, and of those that put the suffix first.
CUT_SHARE = 90
SUFFIX_FIRST_SHARE = 20


@dataclass(frozen=True)
class Marks:
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self) -> None:
        every = [self.prefix, self.suffix, self.middle]
        if not all(every) or len({m[0] for m in every}) > 1 or any(every[0][0] in m[1:] for m in every):
            raise ValueError("marks must start with one character that is nowhere else in them")
        if any(a != b and b.startswith(a) for a in every for b in every) or len(set(every)) < 3:
            raise ValueError("no mark may begin another")


MARKS = Marks()


class ClassRuns:
    """A text's maximal runs of letters A-Z, a-z or of other code points."""

    def __init__(self, text: str) -> None:
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        lower = codes | np.uint32(32)
        letters = (lower >= 97) & (lower <= 122)
        change = np.flatnonzero(letters[1:] != letters[:-1]) + 1
        self.starts = np.concatenate([np.zeros(min(1, len(codes)), np.int64), change])
        lengths = np.diff(self.starts, append=len(codes))
        whole = letters[self.starts]
        #: Code points of a unit in each run, and units before each run.
        self.stride = np.where(whole, lengths, 1)
        units = np.where(whole, 1, lengths)
        self.before = np.cumsum(units) - units
        self.units = int(units.sum())

    def offset(self, units: int) -> int:
        """The code points that the first so many units take."""
        if not units:
            return 0
        run = int(np.searchsorted(self.before, units, "right")) - 1
        return int(self.starts[run] + (units - self.before[run]) * self.stride[run])


@F.pandas_udf(StructType([StructField(c, LongType()) for c in ("units", "first", "second")]))
def _cuts(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for texts, one, other in batches:
        out = np.zeros((len(texts), 3), np.int64)
        for i, (text, a, b) in enumerate(zip(texts, one, other)):
            runs = ClassRuns(text)
            first, second = sorted((a % (runs.units + 1), b % (runs.units + 1)))
            out[i] = runs.units, runs.offset(first), runs.offset(second)
        yield pd.DataFrame(out, columns=["units", "first", "second"])


def draws(id_column: str, seed: int = SEED) -> list[Column]:
    """Four whole numbers below 2^32 from the id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_column).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(
    docs: DataFrame,
    output: str = "output",
    form: str = "form",
    units: str = "n",
    prefix_chars: str = "prefix_chars",
    middle_chars: str = "middle_chars",
    id_column: str = "doc_id",
    marks: Marks = MARKS,
    seed: int = SEED,
    cut_share: int = CUT_SHARE,
    suffix_first_share: int = SUFFIX_FIRST_SHARE,
) -> DataFrame:
    """docs with the transformed text, its form (plain, psm or spm), and units and parts' lengths in code points."""
    text, cut, h3, h4 = unused(docs.withColumns({c: F.lit(0) for c in (output, form, units, prefix_chars, middle_chars)}), "_text", "_cut", "_h3", "_h4")
    h = draws(id_column, seed)
    holds = [F.contains(F.col(text), F.lit(m)) for m in (marks.prefix, marks.suffix, marks.middle)]
    plain = (F.col(text) == "") | holds[0] | holds[1] | holds[2] | (F.col(h3) >= cut_share)
    known = docs.withColumns({text: text_or_empty(), h3: h[2] % 100, h4: h[3] % 100})
    known = known.withColumn(cut, _cuts(F.col(text), h[0], h[1])).withColumn(
        form, F.when(plain, "plain").when(F.col(h4) < suffix_first_share, "spm").otherwise("psm")
    )
    first, second = F.col(f"{cut}.first"), F.col(f"{cut}.second")
    part = lambda start, length: F.substr(F.col(text), (start + 1).cast("int"), length.cast("int"))
    prefix, middle = part(F.lit(0), first), part(first, second - first)
    suffix = part(second, F.length(text) - second)
    p, s, m = (F.lit(x) for x in (marks.prefix, marks.suffix, marks.middle))
    made = (
        F.when(F.col(form) == "psm", F.concat(p, prefix, s, suffix, m, middle))
        .when(F.col(form) == "spm", F.concat(s, suffix, p, prefix, m, middle))
        .otherwise(F.col(text))
    )
    is_cut = F.col(form) != "plain"
    found = {
        output: made,
        units: F.col(f"{cut}.units"),
        prefix_chars: F.when(is_cut, first),
        middle_chars: F.when(is_cut, second - first),
    }
    return known.withColumns(found).drop(text, cut, h3, h4)


def restore(output: Column, form: Column, marks: Marks = MARKS) -> Column:
    """The text that an output of this form was made of."""
    head = F.substring_index(output, marks.middle, 1)
    middle = F.substr(output, F.length(head) + len(marks.middle) + 1)

    def parts(first: str, second: str) -> tuple[Column, Column]:
        opening = F.substring_index(head, second, 1)
        return F.substr(opening, F.lit(len(first) + 1)), F.substr(head, F.length(opening) + len(second) + 1)

    prefix, suffix = parts(marks.prefix, marks.suffix)
    suffix_first, prefix_second = parts(marks.suffix, marks.prefix)
    return (
        F.when(form == "psm", F.concat(prefix, middle, suffix))
        .when(form == "spm", F.concat(prefix_second, middle, suffix_first))
        .otherwise(output)
    )
