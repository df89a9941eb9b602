"""Match positions from regular expressions, with built-in functions only.

Spark's regex functions give the matched strings but not where they stand.
Splitting the text by the same pattern gives the gaps between the matches, so a
running sum over gap and match lengths gives every start and end in code points.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: One found span; ``k`` is the place of its kind in the rule list, so spans sort by start, then kind.
SPAN = "struct<s:int,k:int,e:int>"
NONE = f"array<{SPAN}>"


def found(
    text: Column,
    pattern: str,
    kind: int,
    keep: Callable[[Column], Column] | None = None,
    group: int | None = None,
    keep_group: Callable[[Column], Column] | None = None,
) -> Column:
    """Spans of the leftmost non-overlapping matches of ``pattern``.

    ``keep`` is asked for each matched string, ``keep_group`` for its capture ``group``;
    matches that fail either are left out and nothing is tried in their place.
    """
    rx = F.lit(pattern)
    hits, gaps = F.regexp_extract_all(text, rx, F.lit(0)), F.split(text, pattern, -1)
    parts = hits if group is None else F.regexp_extract_all(text, rx, F.lit(group))
    # Whole arrays are zipped, so that each is made once a text; the last gap has no match.
    both = F.zip_with(hits, gaps, lambda m, g: F.struct(m.alias("m"), g.alias("g")))
    rows = F.zip_with(both, parts, lambda b, p: F.struct(b["m"].alias("m"), b["g"].alias("g"), p.alias("p")))
    test = keep if group is None else keep_group
    sized = F.transform(
        F.filter(rows, lambda r: r["m"].isNotNull()),
        lambda r: F.struct(
            F.length(r["m"]).alias("n"), F.length(r["g"]).alias("g"), (test(r["p"]) if test is not None else F.lit(True)).alias("ok")
        ),
    )
    start = F.struct(F.lit(0).alias("at"), F.array().cast(NONE).alias("out"))
    walked = F.aggregate(
        sized,
        start,
        lambda acc, x: F.struct(
            (acc["at"] + x["g"] + x["n"]).alias("at"),
            F.when(
                x["ok"],
                F.concat(
                    acc["out"],
                    F.array(
                        F.struct(
                            (acc["at"] + x["g"]).alias("s"), F.lit(kind).alias("k"), (acc["at"] + x["g"] + x["n"]).alias("e")
                        )
                    ),
                ),
            )
            .otherwise(acc["out"])
            .alias("out"),
        ),
    )
    return walked["out"]


def joined(spans: Column, kinds: list[str]) -> Column:
    """``kind:start:end`` by start, then kind, comma-joined."""
    names = F.array(*map(F.lit, kinds))
    return F.array_join(
        F.transform(
            spans,
            lambda x: F.concat(F.get(names, x["k"]), F.lit(":"), x["s"].cast("string"), F.lit(":"), x["e"].cast("string")),
        ),
        ",",
    )


def masked(text: Column, spans: Column, mask: str) -> Column:
    """``text`` with every span, overlapping ones merged, replaced by ``mask``. Spans must be sorted."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    walked = F.aggregate(
        spans,
        start,
        lambda acc, x: F.struct(
            F.greatest(acc["at"], x["e"]).alias("at"),
            F.when(
                (x["s"] >= acc["at"]) & (x["e"] > acc["at"]),
                F.concat(acc["out"], F.substring(text, acc["at"] + 1, x["s"] - acc["at"]), F.lit(mask)),
            )
            .otherwise(acc["out"])
            .alias("out"),
        ),
    )
    rest = F.substring(text, walked["at"] + 1, F.length(text))
    return F.when(F.size(spans) == 0, text).otherwise(F.concat(walked["out"], rest))
