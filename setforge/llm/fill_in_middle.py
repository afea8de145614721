"""Fill-in-the-middle transformation.

A text is a row of units, each a word with the blanks before it, or blanks at the
end.  Two hashes of the document's id choose two borders between units, a third
decides whether the text is transformed at all, a fourth in which of two orders:

* ``psm``: ``<P>`` prefix ``<S>`` suffix ``<M>`` middle;
* ``spm``: ``<S>`` suffix ``<P>`` prefix ``<M>`` middle;
* ``plain``: the text as it is; also for empty texts and for those that contain a
  marker, whose pieces could not be told apart again.

A pandas UDF over Arrow batches finds the units' ends once, keeps them in a
compact array and looks up the two ends where the text is sliced.

Scale: one pass without any shuffle; a row's result depends on nothing but its id
and text, so a lost task is simply run again.

Defined cases: null text is empty text, its form plain; a null id counts as empty
text in the hashes; rows of equal id and text give equal results; an empty table
gives an empty result; long texts are read whole, with four bytes a unit beside
the text; other columns of the input are carried along, and new columns avoid
their names.
"""

from __future__ import annotations

import hashlib
from array import array

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from setforge.llm.shared import free_name

MARKERS = ("<P>", "<S>", "<M>")
UNITS = regex.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
FIELDS = ("n", "form", "prefix_chars", "middle_chars", "output", "output_sha256", "restored_sha256")


def unit_ends(text: str) -> array:
    """Where each unit ends, in code points."""
    return array("I", (m.end() for m in UNITS.finditer(text)))


def seeds(doc_id, seed: str) -> tuple[int, int, int, int]:
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))


def transform(doc_id, text: str, seed: str, fim_percent: int, spm_percent: int) -> tuple[int, str, int | None, int | None, str]:
    """Number of units, form, code points of prefix and middle, output."""
    ends, (h1, h2, h3, h4) = unit_ends(text), seeds(doc_id, seed)
    n = len(ends)
    if not n or h3 % 100 >= fim_percent or any(m in text for m in MARKERS):
        return n, "plain", None, None, text
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    cut, stop = ends[first - 1] if first else 0, ends[second - 1] if second else 0
    prefix, middle, suffix = text[:cut], text[cut:stop], text[stop:]
    p, s, m = MARKERS
    if h4 % 100 < spm_percent:
        return n, "spm", cut, stop - cut, "".join((s, suffix, p, prefix, m, middle))
    return n, "psm", cut, stop - cut, "".join((p, prefix, s, suffix, m, middle))


def restore(output: str, form: str) -> str:
    """The text that an output came from."""
    p, s, m = MARKERS
    if form == "plain":
        return output
    first, second = (p, s) if form == "psm" else (s, p)
    one, rest = output[len(first) :].split(second, 1)
    two, middle = rest.split(m, 1)
    prefix, suffix = (one, two) if form == "psm" else (two, one)
    return prefix + middle + suffix


def _sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _transform_udf(seed: str, fim_percent: int, spm_percent: int, with_output: bool, with_digests: bool):
    def run(doc_id: pd.Series, text: pd.Series) -> pd.DataFrame:
        rows = []
        for i, t in zip(doc_id, text):
            n, form, prefix, middle, output = transform(i, t or "", seed, fim_percent, spm_percent)
            digests = (_sha256(output), _sha256(restore(output, form))) if with_digests else (None, None)
            rows.append((n, form, prefix, middle, output if with_output else None, *digests))
        found = pd.DataFrame(rows, columns=FIELDS)
        return found.astype({"n": "int64", "prefix_chars": "Int64", "middle_chars": "Int64"})

    run.__annotations__ = {"doc_id": pd.Series, "text": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(run, "n long, form string, prefix_chars long, middle_chars long, output string, output_sha256 string, restored_sha256 string")


def fill_in_middle(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: str = "42", fim_percent: int = 50, spm_percent: int = 80, with_output: bool = True, with_digests: bool = False
) -> tuple[DataFrame, dict[str, str]]:
    """All rows and columns of ``docs`` with n, form, prefix_chars, middle_chars, output, and digests of output and restored text where asked for.

    The second result maps each of these to the column that holds it.
    """
    wanted = [f for f in FIELDS if (with_output or f != "output") and (with_digests or not f.endswith("sha256"))]
    made = free_name(docs, "__made")
    # ids as text, so that none turns into a float beside a null
    udf = _transform_udf(seed, fim_percent, spm_percent, with_output, with_digests)
    rows = docs.withColumn(made, udf(F.col(id_col).cast("string"), F.col(text_col)))
    at = {f: free_name(docs, f) for f in wanted}
    return rows.select(*docs.columns, *(F.col(made)[f].alias(at[f]) for f in wanted)), at
