"""Fill-in-middle transformation by lookaround splitting.

A text is cut into units (lines, words, runs of a class), two of the cuts between units part it into prefix, middle and suffix, and
these are put in another order behind markers.  A unit grammar says how the units are matched from left to right; it is translated to a regular expression
of no width that looks at the two characters beside a boundary, so that Spark's ``split`` returns the units and no character is lost.
``split`` gives one empty piece for an empty text, which therefore is handled apart: it has no units.

Everything is built-in functions: one narrow pass without Python.

Defined results: a null text is an empty one and stays plain; a null key hashes as an empty string; repeated rows are
transformed alike; other columns, of any name, stay as they are; a text is cut whole, however long it is.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, masked

#: What stands before prefix, suffix and middle.
MARKERS = ("<P>", "<S>", "<M>")
SEED = 7
#: Of 100 texts, how many are transformed, and of these how many begin with the suffix.
RATE, SPM = 100, 50


@dataclass(frozen=True)
class Grammar:
    """Units by a class of characters (the inside of a bracket expression) and the side of a unit on which that class stands.

    * ``ended``: a unit ends behind each character of the class: ``[^c]*[c]|[^c]+``;
    * ``trailing``: a run of the class closes a unit: ``[^c]*[c]+|[^c]+``;
    * ``leading``: a run of the class opens a unit: ``[c]+[^c]*|[^c]+``;
    * ``runs``: runs of the class and of its complement are units: ``[c]+|[^c]+``.
    """

    inside: str
    shape: str = "ended"

    @property
    def units(self) -> str:
        """The expression that matches units from left to right."""
        c = self.inside
        return {"ended": f"[^{c}]*[{c}]|[^{c}]+", "trailing": f"[^{c}]*[{c}]+|[^{c}]+", "leading": f"[{c}]+[^{c}]*|[^{c}]+", "runs": f"[{c}]+|[^{c}]+"}[self.shape]

    @property
    def boundary(self) -> str:
        """The places between units, by the classes of the characters on both sides."""
        c = self.inside
        closes, opens = f"(?<=[{c}])(?=[^{c}])", f"(?<=[^{c}])(?=[{c}])"
        # behind the last character nothing begins: any character must follow
        return {"ended": f"(?<=[{c}])(?=[\\s\\S])", "trailing": closes, "leading": opens, "runs": f"{closes}|{opens}"}[self.shape]


LINES = Grammar(r"\n")
WORDS = Grammar(r"\x20\t-\r", "trailing")
NUMBERS = Grammar("0-9", "runs")


def pieces(text: Column, grammar: Grammar = LINES) -> Column:
    """The units of a text as an array; none for an empty text."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, grammar.boundary, -1))


def numbers(key: Column, seed: int = SEED) -> list[Column]:
    """The first four 32-bit numbers of the hash of a key."""
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(hashed, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def transformed(docs: DataFrame, key: str = "doc_id", text: str = "text", grammar: Grammar = LINES, seed: int = SEED, rate: int = RATE, spm: int = SPM, markers: tuple[str, str, str] = MARKERS) -> DataFrame:
    """The columns of ``docs`` and ``n`` (units), ``form`` (plain, psm or spm), ``prefix_chars`` and ``middle_chars`` (null if plain), ``output``.

    New columns replace such of the same name.
    """
    own, (key, text), back = masked(docs, key, text)
    added = ["n", "form", "prefix_chars", "middle_chars", "output"]
    kept = [c for c in docs.columns if c.lower() not in added]
    p, s, m = (F.lit(x) for x in markers)
    t, h = F.col("_q_text"), numbers(F.col(key), seed)
    cut = own.withColumn("_q_text", F.coalesce(F.col(text), F.lit(""))).withColumn("_q_units", pieces(t, grammar)).withColumn("_q_n", F.size("_q_units"))
    cut = cut.withColumns({"_q_x": (h[0] % (F.col("_q_n") + 1)).cast("int"), "_q_y": (h[1] % (F.col("_q_n") + 1)).cast("int"), "_q_3": h[2], "_q_4": h[3]})
    plain = (t == "") | (F.col("_q_3") % 100 >= rate)
    for x in (p, s, m):
        plain |= F.contains(t, x)
    form = F.when(plain, "plain").when(F.col("_q_4") % 100 < spm, "spm").otherwise("psm")
    low, high = F.least("_q_x", "_q_y"), F.greatest("_q_x", "_q_y")
    part = lambda a, b: F.array_join(F.slice("_q_units", a + 1, b - a), "")
    cut = cut.withColumns({"_q_form": form, "_q_low": low, "_q_high": high})
    a, b = F.col("_q_low"), F.col("_q_high")
    cut = cut.withColumns({"_q_p": part(F.lit(0), a), "_q_m": part(a, b), "_q_s": part(b, F.col("_q_n"))})
    f = F.col("_q_form")
    out = F.when(f == "psm", F.concat(p, "_q_p", s, "_q_s", m, "_q_m")).when(f == "spm", F.concat(s, "_q_s", p, "_q_p", m, "_q_m")).otherwise(t)
    new = {"_q_o_n": F.col("_q_n").cast("long"), "_q_o_form": f, "_q_o_prefix_chars": F.when(f != "plain", F.length("_q_p")).cast("long"), "_q_o_middle_chars": F.when(f != "plain", F.length("_q_m")).cast("long"), "_q_o_output": out}
    done = cut.withColumns(new)
    places = dict(zip(docs.columns, own.columns, strict=True))
    return done.select(*(places[c] for c in kept), *new).toDF(*kept, *added)


def restored(output: Column, form: Column, markers: tuple[str, str, str] = MARKERS) -> Column:
    """The text, rebuilt from the output and its form.

    Each marker stands once in an output that isn't plain: its texts hold none, and a marker can't overlap a text's end, as its
    first character stands in it once only.
    """
    p, s, m = markers
    place = lambda x: F.instr(output, x)
    between = lambda x, y: F.substring(output, place(x) + F.lit(len(x)), place(y) - place(x) - F.lit(len(x)))
    middle = F.substring(output, place(m) + F.lit(len(m)), F.length(output))
    return F.when(form == "psm", F.concat(between(p, s), middle, between(s, m))).when(form == "spm", F.concat(between(p, m), middle, between(s, p))).otherwise(output)


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = transformed(documents(spark, sf_dir).select("doc_id", "text"))
    digest = lambda c: F.sha2(c, 256)
    return got.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


#: Lines are matched from left to right; the restored text is put together from the output's markers.
OP11_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || doc_id) AS h FROM documents),
u AS (
  SELECT doc_id, t, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS u, [('0x' || substr(h, 8 * i + 1, 8))::BIGINT FOR i IN [0, 1, 2, 3]] AS h FROM d
), c AS (
  SELECT doc_id, t, u, len(u) AS n, least(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS a, greatest(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 100 THEN 'plain' WHEN h[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u
), p AS (SELECT *, array_to_string(u[1 : a], '') AS p, array_to_string(u[a + 1 : b], '') AS m, array_to_string(u[b + 1 : n], '') AS s FROM c),
o AS (SELECT *, CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END AS o FROM p)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END::BIGINT AS middle_chars, sha256(o) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN o
    WHEN 'psm' THEN substr(o, 4, instr(o, '<S>') - 4) || substr(o, instr(o, '<M>') + 3) || substr(o, instr(o, '<S>') + 3, instr(o, '<M>') - instr(o, '<S>') - 3)
    ELSE substr(o, instr(o, '<P>') + 3, instr(o, '<M>') - instr(o, '<P>') - 3) || substr(o, instr(o, '<M>') + 3) || substr(o, 4, instr(o, '<P>') - 4) END) AS restored_sha256
FROM o
"""
