"""Checks of written pages: counterparts in the other language, targets of links, the form of messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Endings of pages, what leads to the other language, and what a link looks like.
ENGLISH, VIETNAMESE = ".md", ".vi.md"
SWITCH = "Language / Ngôn ngữ"
LINK = r"(?<!!)\[[^\]]+\]\(([^)]+)\)"
LINE_ENDS = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
LEAST_BULLETS = 2


def counterpart(path: Column) -> Column:
    """The same page in the other language; null for what is no page."""
    return F.when(path.endswith(VIETNAMESE), F.concat(path.substr(F.lit(1), F.length(path) - len(VIETNAMESE)), F.lit(ENGLISH))).when(
        path.endswith(ENGLISH), F.concat(path.substr(F.lit(1), F.length(path) - len(ENGLISH)), F.lit(VIETNAMESE))
    )


def unpaired(pages: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """``path, problem``: pages without a counterpart, and paired ones that do not lead to it.

    Rows with a null path do not count, a repeated path once; a null text leads nowhere.  Counterparts are
    found by a join on the path.
    """
    own = pages.where(F.col(path).isNotNull()).groupBy(F.col(path).alias("path")).agg(
        F.max(F.contains(F.coalesce(F.col(text), F.lit("")), F.lit(SWITCH))).alias("leads")
    )
    there = own.select(F.col("path").alias("peer"), F.lit(True).alias("paired"))
    joined = own.withColumn("peer", counterpart(F.col("path"))).join(there, "peer", "left")
    problem = F.when(F.col("paired").isNull(), "missing counterpart").when(~F.col("leads"), "missing language switch")
    return joined.select("path", problem.alias("problem")).where("problem is not null")


def resolved(path: Column) -> Column:
    """A path without ``.`` and ``..``; null where it leads out of the root."""
    start = F.struct(F.array().cast("array<string>").alias("parts"), F.lit(False).alias("out"))

    def step(s: Column, part: Column) -> Column:
        up = part == ".."
        parts = F.when(up, F.slice(s["parts"], 1, F.greatest(F.size(s["parts"]) - 1, F.lit(0)))).when(
            part.isin("", "."), s["parts"]
        ).otherwise(F.concat(s["parts"], F.array(part)))
        return F.struct(parts.alias("parts"), (s["out"] | (up & (F.size(s["parts"]) == 0))).alias("out"))

    return F.aggregate(F.split(path, "/"), start, step, lambda s: F.when(~s["out"], F.array_join(s["parts"], "/")))


def broken_links(pages: DataFrame, existing: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """``path, target, problem``: links of pages that lead out of the root or to nothing.

    ``existing``: path, the files and folders there are.  Addresses, mail and anchors of the page itself are no targets,
    images neither.  Null texts have no links; repeated links come out once.
    """
    links = pages.select(F.col(path).alias("path"), F.explode(F.regexp_extract_all(F.col(text), F.lit(LINK), 1)).alias("raw"))
    target = F.trim(F.substring_index("raw", "#", 1))
    local = links.select("path", target.alias("target")).where("target <> '' and not contains(target, '://') and not startswith(target, 'mailto:')")
    folder = F.regexp_replace("path", r"[^/]*$", "")
    absolute = F.when(F.col("target").startswith("/"), F.lit(None).cast("string")).otherwise(resolved(F.concat(folder, F.col("target"))))
    there = existing.select(F.col("path").alias("to"), F.lit(True).alias("found")).distinct()
    joined = local.distinct().withColumn("to", absolute).join(there, "to", "left")
    problem = F.when(F.col("to").isNull(), "outside").when(F.col("found").isNull() & (F.col("to") != ""), "missing")
    return joined.select("path", "target", problem.alias("problem")).where("problem is not null")


def message_form(message: Column) -> Column:
    """``subject, bullets, valid`` of a message: its first line, its lines ``- ...`` and whether both are enough."""
    lines = F.split(F.regexp_replace(F.coalesce(message, F.lit("")), r"\s+$", ""), LINE_ENDS)
    subject = F.trim(F.get(lines, F.lit(0)))
    bullets = F.size(F.filter(F.slice(lines, 2, F.size(lines)), lambda x: x.startswith("- ") & (F.length(x) > 2)))
    return F.struct(subject.alias("subject"), bullets.alias("bullets"), ((subject != "") & (bullets >= LEAST_BULLETS)).alias("valid"))
