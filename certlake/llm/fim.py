"""Fill-in-middle transformation of whole texts.

A text becomes a UTF-32 array of code points.  Neighbouring classes are compared, and the places at which they
differ are the boundaries of its units: with ``units="chars"`` every code point is a class of its own, with
``units="words"`` letters, digits, white space and signs are.  Two ranks, drawn from the hash of the row's key, choose
two boundaries; the array is sliced there into prefix, middle and suffix, which are encoded again and put together in
the order of the row's form:

    plain   the text
    psm     <P>prefix<S>suffix<M>middle
    spm     <S>suffix<P>prefix<M>middle

The draws depend on the key alone, so every attempt of a task gives the same rows, and a stretch of the hash never
serves two draws.  Rows are independent: nothing is shuffled.

Null texts are empty texts; these, and texts that contain a mark, are plain.  A null key is the empty string in the
hash.  Repeated rows get equal forms.  Very long texts are cut whole.  The columns ``n``, ``form``, ``prefix_chars``,
``middle_chars`` and ``output`` replace columns of these names; all others stay.  A table without rows gives none.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from certlake.llm.common import spare

P, S, M = "<P>", "<S>", "<M>"
CUT = "struct<n: long, form: string, prefix_chars: long, middle_chars: long, output: string>"


@dataclass(frozen=True)
class FimConfig:
    """``rate`` and ``spm`` are per cents: of the texts that are cut, and of those, of the second form."""

    units: str = "chars"
    rate: int = 90
    spm: int = 20
    seed: int = 1


def classes(points: np.ndarray, units: str) -> np.ndarray:
    """A class for each code point; a unit is a run of one class."""
    if units == "chars":
        return np.arange(len(points))
    if units != "words":
        raise ValueError(f"units are chars or words, not {units!r}")
    out = np.full(len(points), 3, dtype=np.int64)
    ascii_letter = ((points | 32) >= 97) & ((points | 32) <= 122)
    sign = ((points >= 0x2000) & (points <= 0x2BFF)) | ((points >= 0x3000) & (points <= 0x303F))
    out[ascii_letter | ((points >= 0xC0) & ~sign)] = 0
    out[(points >= 48) & (points <= 57)] = 1
    out[np.isin(points, [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]) | ((points >= 0x2000) & (points <= 0x200A))] = 2
    return out


def boundaries(points: np.ndarray, units: str) -> np.ndarray:
    """Where units begin, with both ends of the text."""
    of = classes(points, units)
    inner = np.flatnonzero(of[1:] != of[:-1]) + 1
    return np.concatenate([[0], inner, [len(points)]]) if len(points) else np.zeros(1, dtype=np.int64)


def cut(text: str, h1: int, h2: int, h3: int, h4: int, config: FimConfig) -> tuple:
    """(code points, form, code points of the prefix and of the middle, output)."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    if not len(points) or P in text or S in text or M in text or h3 % 100 >= config.rate:
        return len(points), "plain", None, None, text
    places = boundaries(points, config.units)
    a, b = sorted((int(places[h1 % len(places)]), int(places[h2 % len(places)])))
    prefix, middle, suffix = (part.tobytes().decode("utf-32-le", "surrogatepass") for part in (points[:a], points[a:b], points[b:]))
    if h4 % 100 < config.spm:
        return len(points), "spm", a, b - a, f"{S}{suffix}{P}{prefix}{M}{middle}"
    return len(points), "psm", a, b - a, f"{P}{prefix}{S}{suffix}{M}{middle}"


def transform(docs: DataFrame, key: str = "doc_id", config: FimConfig = FimConfig()) -> DataFrame:
    """``docs`` with the code points of ``text`` (n), its form, the lengths of prefix and middle, and the output."""
    digest = F.sha2(F.concat(F.lit(f"{config.seed}:"), F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))), 256)
    draws = [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]

    @F.pandas_udf(CUT)
    def cut_all(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for texts, *h in batches:
            rows = [cut(text or "", *hs, config) for text, *hs in zip(texts, *h, strict=True)]
            out = pd.DataFrame(rows, columns=["n", "form", "prefix_chars", "middle_chars", "output"])
            yield out.astype({"n": "int64", "prefix_chars": "Int64", "middle_chars": "Int64"})

    held, new = spare(docs.columns, "fim"), ["n", "form", "prefix_chars", "middle_chars", "output"]
    done = docs.select("*", cut_all(F.col("text").cast("string"), *draws).alias(held))
    return done.select(*(f"`{c}`" for c in docs.columns if c.lower() not in new), *(F.col(f"{held}.{c}").alias(c) for c in new))


def restore(output: Column, form: Column) -> Column:
    """The text, from an output and its form."""
    parts = F.split(output, "<[PSM]>", -1)
    psm, spm = F.concat(parts[1], parts[3], parts[2]), F.concat(parts[2], parts[3], parts[1])
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digest_table(docs: DataFrame, config: FimConfig = FimConfig()) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256)."""
    done = transform(docs.select("doc_id", "text"), "doc_id", config)
    restored = restore(F.col("output"), F.col("form"))
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored, 256).alias("restored_sha256"))


ORACLE = """
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS text, cast(length(coalesce(text, '')) AS bigint) AS n,
    sha256('1:' || coalesce(cast(doc_id AS varchar), '')) AS h
  FROM documents),
ranks AS (
  SELECT doc_id, text, n, cast('0x' || substr(h, 1, 8) AS bigint) % (n + 1) AS r1, cast('0x' || substr(h, 9, 8) AS bigint) % (n + 1) AS r2,
    CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
        OR cast('0x' || substr(h, 17, 8) AS bigint) % 100 >= 90 THEN 'plain'
      WHEN cast('0x' || substr(h, 25, 8) AS bigint) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn),
cuts AS (
  SELECT doc_id, text, n, form, least(r1, r2) AS a, greatest(r1, r2) - least(r1, r2) AS m,
    substring(text, 1, least(r1, r2)) AS prefix, substring(text, least(r1, r2) + 1, greatest(r1, r2) - least(r1, r2)) AS middle,
    substring(text, greatest(r1, r2) + 1) AS suffix
  FROM ranks)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN m END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM cuts
"""
