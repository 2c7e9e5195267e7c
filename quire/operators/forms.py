"""Form XObjects: streams that pages, and other forms, draw with ``Do``.

Every page and every form is interpreted once, in its own coordinates, however
often it is drawn.  What it draws is a table of calls; joined level by level,
calls become placements of forms on pages with one matrix each, and what was
found in a form is moved to the page by that matrix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.session import discard, written

from . import formats, pagetree, text
from .corpus import Corpus

KEY = ["file_id", "path", "obj_num"]
AT = ["file_id", "path"]
CALLS = "array<struct<op_ix:int,name:string,matrix:array<double>>>"
UNIT = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)


def compose(m: Column, n: Column) -> Column:
    """The matrix that applies ``m`` first, then ``n``."""
    x = lambda i: m[i]
    y = lambda i: n[i]
    return F.array(
        x(0) * y(0) + x(1) * y(2), x(0) * y(1) + x(1) * y(3), x(2) * y(0) + x(3) * y(2), x(2) * y(1) + x(3) * y(3), x(4) * y(0) + x(5) * y(2) + y(4), x(4) * y(1) + x(5) * y(3) + y(5))


def form_contents(c: Corpus) -> DataFrame:
    """``KEY, stream_decoded`` of every form."""
    forms = c.objects.where("subtype = 'Form' and kind = 'Stream'").select(*KEY)
    return c.streams.select(*KEY, "stream_decoded").join(forms, KEY, "left_semi")


def form_matrices(c: Corpus) -> DataFrame:
    """``KEY, own``: a form's matrix, which counts before that of its call; forms without one have the unit."""
    v = F.coalesce("real_v", F.col("int_v").cast("double"))
    item = lambda i: F.coalesce(F.max(F.when(F.col("ord") == i, v)), F.lit(UNIT[i]))
    given = c.nodes.where("key_path rlike '^Matrix\\\\.\\\\[[0-5]\\\\]$'").groupBy(*KEY).agg(F.array(*[item(i) for i in range(6)]).alias("own"))
    forms = c.objects.where("subtype = 'Form' and kind = 'Stream'").select(*KEY)
    return forms.join(given, KEY, "left").select(*KEY, F.coalesce("own", F.array(*map(F.lit, UNIT))).alias("own"))


def draw_calls(contents: DataFrame) -> DataFrame:
    """``KEY, op_ix, name, matrix`` of each ``Do`` in ``contents``, with the matrix in force."""
    from quire.functions.content import draw_calls, operations

    return text._mapped(contents, lambda raw: draw_calls(operations(raw)), CALLS).select(*KEY, F.inline("_r"))


def placements(c: Corpus, calls: DataFrame | None = None, count_only: bool = False) -> DataFrame:
    """Forms on pages: ``file_id, path, page, obj_num, depth`` with ``at, matrix``, or with ``n``.

    ``at`` lists the operators that lead there, ``matrix`` maps the form's
    coordinates to the page's.  A name stands for what the drawing stream's own
    resources say, else those of the page.  A form that is being drawn is not
    drawn again within itself.  With ``count_only`` placements of a form are
    one row a page, level and way of recursion, with their number, so forms
    that draw others many times stay few rows.
    """
    if calls is None:
        calls = draw_calls(text.content_bytes(c).unionByName(form_contents(c)))
    calls = written(calls, "draw-calls")
    names = written(pagetree.resources(c, "XObject").join(form_matrices(c).withColumnRenamed("obj_num", "ref_num"), [*AT, "ref_num"], "left"), "forms")
    named = names.where("own is not null")
    own = named.select(*AT, F.col("obj_num").alias("caller"), "name", F.col("ref_num").alias("own_form"), F.col("own").alias("own_matrix"))
    page_own = named.select(*AT, F.col("obj_num").alias("page"), "name", F.col("ref_num").alias("page_form"), F.col("own").alias("page_matrix"))
    # Names of a stream's own resources hide those of the page, also where they stand for other things than forms.
    hidden = names.select(*AT, F.col("obj_num").alias("caller"), "name", F.lit(True).alias("hides"))
    pages = c.objects.where("type_name = 'Page'").select(*AT, F.col("obj_num").alias("page"))
    unit = F.array(*map(F.lit, UNIT))
    place = [F.lit(1).cast("long").alias("n")] if count_only else [F.array().cast("array<int>").alias("at"), unit.alias("matrix")]
    level = pages.select(*AT, "page", F.col("page").alias("obj_num"), F.array("page").alias("trail"), *place)
    out, depth = None, 0
    while True:
        step = level.withColumnRenamed("obj_num", "caller").join(calls.withColumnRenamed("matrix", "call").withColumnRenamed("obj_num", "caller"), [*AT, "caller"])
        step = step.join(own, [*AT, "caller", "name"], "left").join(hidden, [*AT, "caller", "name"], "left").join(page_own, [*AT, "page", "name"], "left")
        form = F.coalesce("own_form", F.when(F.col("hides").isNull(), F.col("page_form")))
        matrix = F.when(F.col("own_form").isNotNull(), F.col("own_matrix")).otherwise(F.col("page_matrix"))
        step = step.withColumn("obj_num", form).where("obj_num is not null").where(~F.array_contains("trail", F.col("obj_num")))
        trail = F.array_append("trail", F.col("obj_num"))
        if count_only:
            # Which forms lie above matters, not in what order.
            step = step.withColumn("trail", F.array_sort(trail)).groupBy(*AT, "page", "obj_num", "trail").agg(F.sum("n").alias("n"))
        else:
            step = step.select(*AT, "page", "obj_num", trail.alias("trail"), F.array_append("at", F.col("op_ix")).alias("at"), compose(compose(matrix, F.col("call")), F.col("matrix")).alias("matrix"))
        level = written(step, "placements")
        if level.isEmpty():
            discard(level)
            break
        depth += 1
        part = level.drop("trail").withColumn("depth", F.lit(depth))
        out = part if out is None else out.unionByName(part)
    if out is not None:
        return out
    rest = "n long, depth int" if count_only else "at array<int>, matrix array<double>, depth int"
    return c.parsed.sparkSession.createDataFrame([], f"file_id string, path string, page int, obj_num int, {rest}")


def form_fonts(c: Corpus, placed: DataFrame) -> DataFrame:
    """``KEY, fonts`` of every form: those of its own resources, and for other names those of the first page that draws it."""
    every = formats.page_fonts(c)
    forms = form_matrices(c).select(*KEY)
    entries = lambda rows: rows.select(*KEY, F.explode("fonts").alias("f")).select(*KEY, "f", F.col("f.name").alias("name"))
    own = entries(every.join(forms, KEY, "left_semi"))
    first = placed.groupBy(*KEY).agg(F.min("page").alias("page"))
    lent = entries(every.withColumnRenamed("obj_num", "page").join(first, [*AT, "page"]).select(*KEY, "fonts"))
    rows = own.withColumn("rank", F.lit(0)).unionByName(lent.withColumn("rank", F.lit(1)))
    return rows.groupBy(*KEY, "name").agg(F.min_by("f", "rank").alias("f")).groupBy(*KEY).agg(F.collect_list("f").alias("fonts"))


def text_runs(c: Corpus, with_fonts: bool = True) -> DataFrame:
    """Shown strings of pages and of the forms on them: ``KEY`` of the page, ``holder``, ``at``, and ``text.text_runs``' columns.

    ``at`` holds the numbers of the operators that lead to the string, so
    sorting by it gives the order of drawing; ``x, y`` are on the page.
    """
    pages, forms = text.content_bytes(c), form_contents(c)
    placed = placements(c, draw_calls(pages.unionByName(forms)))
    if with_fonts:
        fonts = formats.page_fonts(c)
        own, inner = text.text_runs(pages, fonts), text.text_runs(forms, form_fonts(c, placed))
    else:
        own, inner = text.text_runs(pages), text.text_runs(forms)
    rest = [x for x in own.columns if x not in (*KEY, "op_ix", "x", "y")]
    on_page = own.select(*KEY, F.col("obj_num").alias("holder"), F.array("op_ix").alias("at"), "x", "y", *rest)
    m, x, y = F.col("matrix"), F.col("x"), F.col("y")
    moved = placed.join(inner, KEY).select(
        *AT, F.col("page").alias("obj_num"), F.col("obj_num").alias("holder"), F.array_append("at", F.col("op_ix")).alias("at"), (x * m[0] + y * m[2] + m[4]).alias("x"), (x * m[1] + y * m[3] + m[5]).alias("y"), *rest)
    return on_page.union(moved)


def path_counts(c: Corpus) -> DataFrame:
    """``text.path_counts`` of pages with the forms on them, each as often as it is drawn."""
    pages, forms = text.content_bytes(c), form_contents(c)
    counts = written(text.path_counts(text.content_ops(pages.unionByName(forms))), "path-counts")
    names = [x for x in counts.columns if x.startswith("n_")]
    placed = placements(c, count_only=True).join(counts, KEY).select(*AT, F.col("page").alias("obj_num"), *[(F.col(k) * F.col("n")).alias(k) for k in names])
    own = counts.join(c.objects.where("type_name = 'Page'").select(*KEY), KEY, "left_semi").select(*KEY, *names)
    return own.union(placed).groupBy(*KEY).agg(*[F.sum(k).alias(k) for k in names])
