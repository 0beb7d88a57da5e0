"""Problem 5: the main body of web pages, by consensus of the pages of a host.

The containers of a captured page are its lines. A container's generalised path is its host, its zone (above or below the
page's own heading) and its template: the line with numbers, the host's name and the page's subject left open. The heading
is the first line that names the page's subject (from the people column or the address) and is no trail of links.

1. Every container gets a score on its own page: what stands above the heading, or on a page without one, and what does not
   end as a sentence does, is no main body.
2. The paths vote, per host and over all hosts: how many pages hold the template, how often it stands above a heading, and
   whether it is found on this host alone. A template that a good share of a host's pages hold, that also stands above
   headings, or that one host repeats and no other knows, belongs to the site and not to the page.
3. The pages are read again with the winning paths: heading, and all containers below it that neither score nor vote rules out.

A page has one vote for each template, however often it repeats the line: templates are made distinct inside the page's row.
Votes are counts with map-side partial sums; a host that holds a third of all pages adds no more rows to a vote than it has
different templates, and the votes come back by a join that AQE may split. All work is done in the JVM.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parolith.llm.common import cut, not_blank, quoted, with_id

HOST_SHARE, HOST_LEAST = 0.2, 5
ABOVE_SHARE, ABOVE_LEAST = 0.1, 2
OWN_SHARE, OWN_PAGES, OWN_LEAST = 0.8, 0.04, 3
#: A line that ends so is a sentence; scripts without a full stop need none.
_SENTENCE = r"[.!?…。！？।؟۔։።]['\"”’»」』)\]]*$|[฀-໿က-႟ក-៿]['\"”’»」』)\]]*$"
_TRAIL = r"[|>»·›•]"
_WHITE = r"^[\s 　﻿]+|[\s 　﻿]+$"


def _subject(people: Column, url: Column) -> Column:
    """What the page is about: the people column, else the last path segment but an ordinal one."""
    path = F.regexp_extract(url, r"^[a-zA-Z]+://[^/]+/(.*?)/?(?:[?#].*)?$", 1)
    segment = F.regexp_extract(path, r"([^/]*[^/0-9][^/]*)(?:/[0-9]+)?$", 1)
    decoded = F.try_url_decode(F.regexp_replace(segment, "[+]", "%2B"))
    return F.coalesce(F.nullif(F.trim(people), F.lit("")), F.nullif(F.trim(F.translate(F.coalesce(decoded, segment), "_", " ")), F.lit("")))


def page_containers(df: DataFrame, id_col: str, url_col: str, people_col: str, text_col: str) -> DataFrame:
    """(page, host, items): a row per page with a text; items are its lines that aren't blank as (line_no, line, template, zone, sentence).

    zone is -1 above the heading, 0 for it, 1 below.
    """
    host = F.lower(F.regexp_extract(quoted(url_col), r"^[a-zA-Z]+://(?:www\.)?([^/:?#]+)", 1))
    pages = with_id(df, id_col).select(quoted(id_col).cast("long").alias("page"), F.coalesce(host, F.lit("")).alias("host"), _subject(quoted(people_col).cast("string"), quoted(url_col)).alias("subject"), quoted(text_col).cast("string").alias("text"))
    lines = pages.where(not_blank("text")).withColumn("lines", F.split("text", "\n"))
    own = F.expr("filter(sequence(0, size(lines) - 1), i -> contains(lower(lines[i]), lower(subject)) and length(lines[i]) <= length(subject) + 60 and not lines[i] rlike '%s')" % _TRAIL)
    lines = lines.withColumn("at", F.coalesce(F.when(F.col("subject").isNotNull(), F.try_element_at(own, F.lit(1))), F.lit(-1)))
    bare = F.transform("lines", lambda raw, i: F.struct(i.alias("line_no"), F.regexp_replace(raw, _WHITE, "").alias("line")))

    def container(x: Column) -> Column:
        low = F.lower(x["line"])
        named = F.replace(F.replace(low, F.lower("subject"), F.lit("\x01")), F.col("host"), F.lit("\x02"))
        open_ = F.regexp_replace(F.when(F.col("subject").isNull() | (F.col("host") == ""), low).otherwise(named), "[0-9]+", "0")
        zone = F.when(F.col("at") < 0, -1).otherwise(F.signum(x["line_no"] - F.col("at")).cast("int"))
        return F.struct(x["line_no"].alias("line_no"), x["line"].alias("line"), F.xxhash64(open_).alias("template"), zone.alias("zone"), x["line"].rlike(_SENTENCE).alias("sentence"))

    return lines.select("page", "host", F.transform(F.filter(bare, lambda x: x["line"] != ""), container).alias("items"))


def site_paths(pages: DataFrame) -> DataFrame:
    """(host, template) of the paths that the votes give to the site; host is null for a template that goes for all hosts."""
    sizes = pages.groupBy("host").agg(F.count("*").alias("pages"))

    def templates(of: Callable[[Column], Column]) -> Column:
        return F.array_distinct(F.transform(F.filter("items", of), lambda x: x["template"]))

    held = F.transform(templates(lambda x: x["zone"] != 0), lambda t: F.struct(t.alias("template"), F.lit(0).alias("above")))
    above = F.transform(templates(lambda x: x["zone"] < 0), lambda t: F.struct(t.alias("template"), F.lit(1).alias("above")))
    votes = pages.select("host", F.explode(F.concat(held, above)).alias("v")).select("host", "v.template", "v.above")
    per_host = votes.groupBy("host", "template").agg(F.count_if(F.col("above") == 0).alias("n"), F.sum("above").alias("above"))
    per_host = cut(per_host.join(sizes, "host"))
    overall = per_host.groupBy("template").agg(F.sum("n").alias("n_all"), F.sum("above").alias("above_all"), F.max(F.when(F.col("n") >= HOST_LEAST, F.col("n") / F.col("pages"))).alias("top"))
    everywhere = overall.where(((F.col("above_all") >= ABOVE_LEAST) & (F.col("above_all") >= ABOVE_SHARE * F.col("n_all"))) | (F.col("top") >= HOST_SHARE)).select(F.lit(None).cast("string").alias("host"), "template")
    alone = per_host.where((F.col("n") >= OWN_LEAST) & (F.col("n") >= OWN_PAGES * F.col("pages"))).join(overall.select("template", "n_all"), "template").where(F.col("n") >= OWN_SHARE * F.col("n_all"))
    return everywhere.union(alone.select("host", "template"))


def judge_lines(df: DataFrame, id_col: str, url_col: str, people_col: str, text_col: str) -> DataFrame:
    """(page, line_no, line, main) of every line that isn't blank; line_no counts from 0 the lines between line feeds.

    Pages with a null or blank text have no lines; a page whose heading isn't found (no subject known, or not named) has no
    main body; a null address is a host of its own name; repeated lines are judged alike; other columns take no part.
    """
    pages = cut(page_containers(df, id_col, url_col, people_col, text_col))
    paths = cut(site_paths(pages))
    lines = pages.select("page", "host", F.inline("items"))
    everywhere = paths.where("host is null").select("template", F.lit(True).alias("all_sites"))
    own = paths.where("host is not null").select("host", "template", F.lit(True).alias("own_site"))
    judged = lines.join(everywhere, "template", "left").join(own, ["host", "template"], "left")
    site = F.coalesce(F.col("all_sites"), F.lit(False)) | F.coalesce(F.col("own_site"), F.lit(False))
    main = (F.col("zone") == 0) | ((F.col("zone") > 0) & F.col("sentence") & ~site)
    return judged.select("page", "line_no", "line", main.alias("main"))


def main_bodies(df: DataFrame, id_col: str, url_col: str, people_col: str, text_col: str) -> DataFrame:
    """(page, n_lines, n_main, body): the main body of every page with a text, its lines in order; an empty one where there is none."""
    lines = judge_lines(df, id_col, url_col, people_col, text_col)
    kept = F.sort_array(F.collect_list(F.when(F.col("main"), F.struct("line_no", "line"))))
    return lines.groupBy("page").agg(F.count("*").alias("n_lines"), F.count_if("main").alias("n_main"), kept.alias("kept")).select("page", "n_lines", "n_main", F.concat_ws("\n", F.col("kept.line")).alias("body"))
