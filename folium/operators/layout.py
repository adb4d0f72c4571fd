"""Text elements of a page: clusters, gaps, tags, reading order, links."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _page():
    return Window.partitionBy("page").orderBy("seq")


def _so_far():
    return _page().rowsBetween(Window.unboundedPreceding, 0)


def clusters(elements: DataFrame) -> DataFrame:
    """Elements with ``cluster``: a new one begins where an element doesn't start exactly where the one before ended."""
    touching = (F.col("x") == F.lag(F.col("x") + F.col("dx")).over(_page())) & (F.col("y") == F.lag(F.col("y") + F.col("dy")).over(_page()))
    return elements.withColumn("cluster", F.sum(F.when(F.coalesce(touching, F.lit(False)), 0).otherwise(1)).over(_so_far()))


def cluster_totals(clustered: DataFrame) -> DataFrame:
    """Per cluster: widths and characters summed, start and end, the common font and size or else ``Various`` and 0."""
    first, last = F.min(F.struct("seq", "x", "y")), F.max(F.struct("seq", (F.col("x") + F.col("dx")).alias("x"), (F.col("y") + F.col("dy")).alias("y")))
    one = lambda c, other: F.when(F.min(c) == F.max(c), F.min(c)).otherwise(F.lit(other))
    grouped = clustered.groupBy("page", "cluster").agg(first.alias("a"), last.alias("b"), F.sum("width").alias("width"), F.sum("n_chars").alias("n_chars"), F.sum("n_spaces").alias("n_spaces"), one("font", "Various").alias("font"), one("font_size", 0.0).alias("font_size"), F.transform(F.sort_array(F.collect_list(F.struct("seq", "text"))), lambda e: e["text"]).alias("texts"))
    return grouped.select("page", "cluster", F.col("a.x").alias("start_x"), F.col("a.y").alias("start_y"), F.col("b.x").alias("end_x"), F.col("b.y").alias("end_y"), "width", "n_chars", "n_spaces", "font", "font_size", F.array_join("texts", "").alias("text"))


def inner_spaces(clustered: DataFrame) -> DataFrame:
    """Whether a blank stands before an element of a cluster: its left neighbour advances more than its width by a third
    of the average character, and the cluster has no white characters of its own."""
    own = Window.partitionBy("page", "cluster")
    average = F.sum("width").over(own) / F.nullif(F.sum(F.col("n_chars") - F.col("n_spaces")).over(own), F.lit(0))
    order = own.orderBy("seq")
    wide = F.lag(F.col("dx") - F.col("width")).over(order) > average / 3
    return clustered.withColumn("space_before", F.coalesce(wide & (F.sum("n_spaces").over(own) == 0), F.lit(False)))


def cluster_tags(totals: DataFrame) -> DataFrame:
    """What goes before each cluster: a blank, or a line break where the cursor jumps back, and the structural tags.

    ``ydiff`` of the last backward line break is carried along, so a larger step than 1.5 times it is a section break.
    """
    order = Window.partitionBy("page").orderBy("cluster")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    average = F.col("width") / F.nullif(F.col("n_chars"), F.lit(0))
    t = totals.withColumn("gap", F.col("start_x") - F.lag("end_x").over(order)).withColumn("ystep", F.col("start_y") - F.lag("start_y").over(order)).withColumn("ydiff", F.abs("ystep"))
    t = t.withColumn("back", F.coalesce(F.col("gap") < -7 * average, F.lit(False))).withColumn("space", F.coalesce(F.col("gap") > average / 3, F.lit(False)))
    old = F.coalesce(F.last(F.when(F.col("back") & (F.col("ydiff") > 0), F.col("ydiff")), ignorenulls=True).over(before), F.lit(0.0))
    t = t.withColumn("jump", F.coalesce(F.col("ydiff") > 1.5 * old, F.lit(False)))
    size = F.col("font_size") - F.lag("font_size").over(order)
    whole = lambda c: F.when(c < 0, F.ceil(c)).otherwise(F.floor(c)).cast("int")
    has = F.col("gap").isNotNull()
    tags = F.array_compact(
        F.array(
            F.when(F.col("back") & ~F.col("space"), F.lit("<_pdf _cr/>")),
            F.when(F.col("jump") & F.col("back"), F.lit("<_pdf _sbr/>")),
            F.when(has & ~F.col("jump") & (F.col("ydiff") > 0) & ~(F.col("back") & ~F.col("space")), F.concat(F.lit("<_pdf _ydiff="), F.when(F.col("ystep") > 0, "+").otherwise("-"), (whole(F.col("ydiff")) + 1).cast("string"), F.lit("/>"))),
            F.when(has & (size != 0), F.concat(F.lit("<_pdf _fsc="), F.when(size > 0, "+").otherwise(""), whole(size + 0.5).cast("string"), F.lit("/>"))),
            F.when(has & (F.col("font") != F.lag("font").over(order)), F.concat(F.lit("<_pdf _fnc="), "font", F.lit("/>"))),
        )
    )
    return t.withColumn("tags", tags)


def page_text(tagged: DataFrame, tags: bool = False) -> DataFrame:
    """``page, text``: clusters in order with the blanks, breaks and tags between them."""
    lead = F.when(F.col("space"), " ").when(F.col("back"), "\n").otherwise("")
    if tags:
        lead = F.concat(lead, F.when(F.size("tags") > 0, F.concat(F.lit(" "), F.array_join("tags", " "), F.lit(" "))).otherwise(""))
    parts = tagged.select("page", F.struct("cluster", F.concat(lead, "text").alias("t")).alias("s"))
    return parts.groupBy("page").agg(F.array_join(F.transform(F.sort_array(F.collect_list("s")), lambda s: s["t"]), "").alias("text"))


def whole_text(pages: DataFrame, key: str = "path") -> DataFrame:
    """Pages of a document as one text, each after its page mark."""
    marked = F.struct("page", F.concat(F.lit("<_pdf _page="), F.col("page").cast("string"), F.lit("/>\n"), "text").alias("t"))
    return pages.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(marked)), lambda s: s["t"]), "\n").alias("text"))


def bridges(elements: DataFrame, centre: float) -> DataFrame:
    """``page, y`` of elements that cross the page's centre."""
    return elements.where((F.col("x") + F.col("width") > centre) & (F.col("x") < centre)).select("page", "y")


def near_bridge(elements: DataFrame, bridge: DataFrame, reach: float = 5.0) -> DataFrame:
    """Elements with a bridge less than ``reach`` away, by buckets of that height: a band join as an equi-join."""
    b = bridge.select("page", F.col("y").alias("by"), F.explode(F.array(*(F.floor(F.col("y") / reach) + k for k in (-1, 0, 1)))).alias("k")).distinct()
    return elements.withColumn("k", F.floor(F.col("y") / reach)).join(b, ["page", "k"], "inner").where(F.abs(F.col("y") - F.col("by")) < reach).select(*elements.columns).distinct()


def sorted_chain(elements: DataFrame) -> DataFrame:
    """``ordinal`` by page, then rows of rounded height from the top, then from the left."""
    order = Window.partitionBy("page").orderBy(F.desc(F.floor(F.col("y") + 0.5)), "x", "seq")
    return elements.withColumn("ordinal", F.row_number().over(order))


def reading_order(elements: DataFrame, width: float, centre: float) -> DataFrame:
    """``page, seq, ordinal``: from the first element always on to the cheapest one left, a page at a time.

    The cost favours height over distance from the left; crossing to the right column costs more unless the line has a
    bridge. The choice depends on the element before, so a page is one group in Python.
    """

    def run(f):
        import numpy as np
        import pandas as pd

        f = f.sort_values("seq")
        x, y, w = f["x"].to_numpy(), f["y"].to_numpy(), f["width"].to_numpy()
        spans = y[(x + w > centre) & (x < centre)]
        left, order = np.ones(len(f), bool), [0]
        left[0] = False
        base = x - 2.1 * y * width
        while left.any():
            at = order[-1]
            cost = base + np.where((x > centre) & (x[at] < centre) & (not (np.abs(y[at] - spans) < 5).any()), 2.0 * y * width, 0.0)
            k = int(np.argmin(np.where(left, cost, np.inf)))
            left[k] = False
            order.append(k)
        return pd.DataFrame({"page": f["page"].iloc[0], "seq": f["seq"].to_numpy()[order], "ordinal": np.arange(1, len(f) + 1)})

    return elements.groupBy("page").applyInPandas(run, "page int, seq int, ordinal int")


def advance(shown: DataFrame) -> DataFrame:
    """Cursor before each shown string of a line, the running sum of ``((w - tj / 1000) * size + charsp + wordsp) * hscale``."""
    step = ((F.col("w") - F.col("tj") / 1000) * F.col("size") + F.col("charsp") + F.col("wordsp")) * F.col("hscale")
    return shown.withColumn("x", F.coalesce(F.sum(step).over(Window.partitionBy("line").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))


def in_box(x, y, left, bottom, right, top):
    """Point in a box, open to the right, closed at the top."""
    return (x >= left) & (x < right) & (y >= bottom) & (y <= top)


def link_texts(links: DataFrame, elements: DataFrame) -> DataFrame:
    """``page, uri, text``: what stands in a link's rectangle, by the middle of each element, in order."""
    e = elements.select("page", "seq", "text", (F.col("x") + F.col("dx") / 2).alias("mx"), (F.col("y") + F.col("dy") / 2).alias("my"))
    inside = in_box(F.col("mx"), F.col("my"), F.col("left"), F.col("bottom"), F.col("left") + F.col("width"), F.col("bottom") + F.col("height"))
    hit = links.withColumn("link", F.monotonically_increasing_id()).join(e, "page").where(inside)
    return hit.groupBy("page", "link", "uri").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "text"))), lambda s: s["text"]), "").alias("text")).drop("link")
