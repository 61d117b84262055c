"""Deterministic stand-ins for invoices, detections, pages and stores, derived from the supplied tables."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.sources import images, pdf
from docketry.sources.shared import new_path


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of every document as a token at a place on its line."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "words"))
    words = docs.select("doc_id", "line", F.posexplode(F.filter(F.split("words", " "), lambda w: w != "")).alias("pos", "text"))
    return words.select("doc_id", "line", "pos", "text", (60 * F.col("pos")).alias("x1"), (60 * F.col("pos") + 50).alias("x2"), (30 * F.col("line")).alias("y1"), (30 * F.col("line") + 20).alias("y2"))


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quotation for each order: dealer, model, horse power and cost, unperturbed."""
    parts = read(spark, sf_dir, "part").select("p_partkey", "p_size")
    n = parts.count()
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice").withColumn("p_partkey", F.col("o_orderkey") % n)
    customers = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey", "c_mktsegment")
    nations = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    joined = orders.join(customers, "o_custkey").join(nations, "c_nationkey").join(parts, "p_partkey")
    return joined.select(
        F.col("o_orderkey").alias("doc_id"), "n_name", F.col("c_mktsegment").alias("segment"), (F.col("p_size") + 500).alias("model"),
        (15 + 2 * F.col("p_size")).cast("bigint").alias("hp"), (100_000 + F.floor("o_totalprice")).cast("bigint").alias("cost"),
    )


DOCUMENTS = 50_000  # of a partition, so that its tokens are sorted in memory


def by_document(spark: SparkSession, sf_dir: str, base: DataFrame) -> DataFrame:
    """``base`` dealt and ordered by document while a document is one narrow row: its tokens stay where it is, are not shuffled,
    and come to their sort in order."""
    n = read(spark, sf_dir, "orders").count()  # from the file's footer
    return base.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // DOCUMENTS)), "doc_id").sortWithinPartitions("doc_id")


def quote_tokens(spark: SparkSession, sf_dir: str, base: DataFrame | None = None) -> DataFrame:
    """The tokens that recognition would find on each quotation, with its usual faults by ``doc_id``."""
    off = lambda k, r: F.col("doc_id") % k == r
    hp, cost = F.col("hp").cast("string"), F.col("cost").cast("string")
    hp_text = F.when(off(17, 4), "250").when(off(7, 1), F.concat(hp, F.lit("HP"))).when(off(13, 3), F.replace(hp, F.lit("0"), F.lit("O"))).otherwise(hp)
    commas = F.concat(F.substring(cost, 1, 1), F.lit(","), F.substring(cost, 2, 2), F.lit(","), F.substring(cost, 4, 3))
    cost_text = F.when(off(5, 1), commas).otherwise(cost)
    q = by_document(spark, sf_dir, quotes(spark, sf_dir) if base is None else base).withColumns({"hp_text": hp_text, "cost_text": cost_text})
    layout = [
        (0, 40, [F.col("n_name"), F.col("segment"), F.lit("TRACTORS")]),
        (1, 700, [F.lit("Tractor"), F.lit("Model"), F.lit(":"), F.lit("Mahindra"), F.col("model").cast("string"), F.lit("DI")]),
        (2, 760, [F.when(~off(11, 2), "Horse"), F.when(~off(11, 2), "Power"), F.lit(":"), F.col("hp_text"), F.when(~off(7, 1) & ~off(11, 2), "HP")]),
        (3, 1500, [F.when(~off(19, 5), "Grand"), F.when(~off(19, 5), "Total"), F.lit(":"), F.col("cost_text")]),
        (4, 1700, [F.when(off(23, 6), "M/s"), F.when(off(23, 6), F.col("n_name")), F.when(off(23, 6), "MOTORS"), F.when(off(23, 6), "Ltd")]),
        (5, 1900, [F.lit("Thank"), F.lit("you")]),
    ]
    texts = [t for _, _, texts in layout for t in texts]
    places = F.array(*(F.struct(F.lit(y).alias("y"), F.lit(p).alias("p")) for _, y, texts in layout for p in range(len(texts))))
    # a row for each place, told by its number; an array of a document's texts would be made and thinned out by code that is not compiled
    lacking = reduce(add, (F.when(t.isNull(), 1 << k).otherwise(0) for k, t in enumerate(texts)))
    every = q.withColumn("lacking", lacking).select("*", F.posexplode(places).alias("k", "c"))
    bit = F.call_function("shiftleft", F.lit(1), F.col("k"))
    there = every.where(F.col("lacking").bitwiseAND(bit) == 0)
    rows = there.select("doc_id", (F.col("k") - F.bit_count(F.col("lacking").bitwiseAND(bit - 1))).alias("tok_idx"), "c", F.elt(F.col("k") + 1, *texts).alias("text"))
    x, y = 60 + 110 * F.col("c.p"), F.col("c.y")
    conf = F.lit(0.6) + (F.col("doc_id") * 31 + F.col("tok_idx") * 7) % 40 / F.lit(100.0)
    return rows.select("doc_id", "tok_idx", "text", x.alias("x1"), y.alias("y1"), (x + 100).alias("x2"), (y + 20).alias("y2"), conf.alias("conf"))


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A detection for each event, on the page of its user."""
    e = F.col("event_id")
    cls = F.when(F.col("event_type").isin("view", "click"), "signature").when(F.col("event_type").isin("purchase", "signup"), "stamp").otherwise("logo")
    x, y = (e % 500).cast("int"), (e * 7 % 700).cast("int")
    return read(spark, sf_dir, "events").select(
        F.col("user_id").alias("doc_id"), e.alias("seq"), cls.alias("cls"), x.alias("x1"), y.alias("y1"), (x + 20 + e % 60).cast("int").alias("x2"), (y + 10 + e % 30).cast("int").alias("y2"), (e % 100 / F.lit(100.0)).alias("conf")
    )


def doc_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of one host as pages of one document, in order of page_id."""
    from pyspark.sql import Window

    pages = read(spark, sf_dir, "pages").select(F.regexp_extract("url", "https?://([^/?#]+)", 1).alias("doc"), "page_id", F.regexp_replace("html", "<[^>]*>", " ").alias("text"))
    host = Window.partitionBy("doc")
    return pages.withColumn("page_index", F.row_number().over(host.orderBy("page_id")) - 1).withColumn("page_count", F.count("*").over(host))


def store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored document for each event."""
    e = F.col("event_id")
    status = F.when(F.col("event_type").isin("purchase", "view"), "completed").when(F.col("event_type") == "error", "failed").otherwise("processing")
    return read(spark, sf_dir, "events").select(
        F.concat(F.lit("doc-"), e).alias("id"), F.concat(F.lit("file_"), e % 997, F.lit(".pdf")).alias("fileName"), F.concat(F.lit("Dealer "), F.col("user_id") % 50).alias("dealerName"),
        F.concat(F.lit("Model "), e % 31).alias("modelName"), status.alias("status"), (e % 101).cast("int").alias("confidence"), F.concat((e % 300 / F.lit(10.0)).cast("decimal(6,1)"), F.lit("s")).alias("processingTime"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("uploadedAt"), e.alias("seq"),
    )


@lru_cache(4096)  # files that look alike are drawn once
def _drawn(width: int, height: int, x: int, y: int, w: int, h: int, ink: tuple[int, int, int], pages: int) -> bytes:
    made = []
    for page in range(pages):
        image = np.full((height, width, 3), 255, np.uint8)
        image[y : y + h, x + 5 * page : x + 5 * page + w] = ink
        made.append(image)
    return images.as_png(made[0]) if pages == 1 else b"".join(map(images.as_anymap, made))


def scans(spark: SparkSession, sf_dir: str) -> str:
    """A folder of archives with an image file for each customer: a patch of ink on white paper, blue, red or grey. A tenth are
    anymaps of three pages, on which the patch wanders, the others PNG files; of some files the second half is lost."""
    k = F.col("c_custkey")
    ink = F.when(k % 7 == 3, F.array(*map(F.lit, (120, 120, 120)))).when(k % 3 == 0, F.array(*map(F.lit, (200, 40, 50)))).otherwise(F.array(*map(F.lit, (30, 40, 160))))
    cells = {"width": 140 + 8 * (k % 5), "height": 100 + 10 * (k % 3), "x": 14 + k % 30, "y": 12 + k % 20, "w": 24 + k % 9, "h": 22 + k % 7}
    plans = read(spark, sf_dir, "customer").select("c_custkey", *(v.cast("int").alias(c) for c, v in cells.items()), ink.alias("ink"))

    sizes = list(cells)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, contents = [], []
            for r in batch.to_pylist():
                pages = 3 if r["c_custkey"] % 10 == 1 else 1
                content = _drawn(*(r[c] for c in sizes), tuple(r["ink"]), pages)
                names.append(f"scan-{r['c_custkey']}.{'png' if pages == 1 else 'ppm'}")
                contents.append(content[: len(content) // 2] if r["c_custkey"] % 25 == 7 or r["c_custkey"] % 100 == 41 else content)
                if len(names) == 256:
                    yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(contents, pa.binary())], ["name", "content"])
                    names, contents = [], []
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(contents, pa.binary())], ["name", "content"])

    folder = new_path(spark, "scans")
    plans = plans.repartition(spark.sparkContext.defaultParallelism, "c_custkey").sortWithinPartitions("c_custkey")  # in one order, if a task runs again
    images.write_archives(plans.mapInArrow(draw, "name string, content binary"), folder)
    return folder


def six_fields(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Labels and flat results of a document for each customer, with the usual slips by key; some results are missing."""
    k = F.col("c_custkey")
    rows = read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", F.col("c_nationkey").alias("n_nationkey")).join(read(spark, sf_dir, "nation").select("n_nationkey", "n_name"), "n_nationkey")
    dealer, model = F.concat_ws(" ", "n_name", "c_mktsegment", F.lit("MOTORS")), F.concat(F.lit("Mahindra "), 500 + k % 97, F.lit(" DI"))
    hp, cost = (15 + 2 * (k % 40)).cast("int"), (100_000 + 13 * k).cast("long")
    labels = rows.select(F.concat(F.lit("doc-"), k).alias("doc_id"), dealer.alias("dealer_name"), model.alias("model_name"), hp.alias("horse_power"), cost.alias("asset_cost"), (k % 2 == 0).alias("signature_present"), (k % 3 == 0).alias("stamp_present"))
    said = F.when(k % 6 == 0, dealer).when(k % 6 == 1, F.concat(F.lit("M/s. "), F.lower(dealer), F.lit(" & Sons"))).when(k % 6 == 2, F.concat(F.substring("n_name", 1, 3), F.lit("X"), F.substring("n_name", 5, 30), F.lit(" "), F.col("c_mktsegment"), F.lit(" MOTOR"))).when(k % 6 == 3, F.col("n_name")).when(k % 6 == 4, F.concat(F.lit("the"), dealer, F.lit("hall")))
    named = F.when(k % 5 == 0, F.upper(model)).when(k % 5 == 1, F.concat(F.lit("mahindra "), 501 + k % 97)).when(k % 5 == 2, F.concat(500 + k % 97, F.lit("-DI, MAHINDRA tractor"))).when(k % 5 == 3, F.concat(F.lit("Mahindra DI model "), k % 7))
    results = rows.where(k % 31 != 3).select(
        F.concat(F.lit("doc-"), k).alias("doc_id"), said.alias("dealer_name"), named.alias("model_name"), F.when(k % 7 == 0, hp + 9).otherwise(hp).alias("horse_power"), F.when(k % 11 != 0, cost).alias("asset_cost"),
        (k % 4 == 0).alias("signature_present"), (k % 3 == 0).alias("stamp_present"), F.when(k % 29 == 5, "corrupt_input: x").alias("error"), (k % 300 / F.lit(10.0)).alias("processing_time_sec"),
    )
    return labels, results


def result_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON line for each event, by key sound or with one fault or more."""
    e = F.col("event_id")
    conf = F.when(e % 7 == 1, "1.5").when(e % 7 == 2, "null").otherwise("0.5")
    box = F.when(e % 5 == 0, "null").when(e % 5 == 1, "[9,1,3,4]").when(e % 5 == 2, "[1,2,3]").when(e % 5 == 3, "[1,2,3.5,4]").otherwise("[1,2,3,4]")
    hp = F.when(e % 3 == 0, '"fifty"').otherwise("50")
    text = lambda value, c: F.concat(F.lit('{"value":'), value, F.lit(',"confidence":'), c, F.lit("}"))
    sign = F.concat(F.lit('{"present":true,"bbox":'), box, F.when(e % 11 == 0, ',"ink":"blue"').otherwise(""), F.lit(',"confidence":0.25}'))
    fields = F.concat(
        F.lit('{"dealer_name":'), text(F.lit('"A"'), conf), F.lit(',"model_name":'), text(F.lit("null"), F.lit("0")), F.lit(',"horse_power":'), text(hp, F.lit("1")), F.lit(',"asset_cost":'), text(F.lit("1"), F.lit("0.1")),
        F.lit(',"signature":'), sign, F.when(e % 13 == 0, "").otherwise(',"stamp":{"present":false,"bbox":null,"confidence":0}'), F.lit("}"),
    )
    line = F.concat(F.lit('{"doc_id":"'), e, F.lit('","fields":'), fields, F.when(e % 17 == 0, ',"zeal":1,"note":2').otherwise(""), F.lit(',"confidence":0.5}'))
    return read(spark, sf_dir, "events").select(e.alias("doc_id"), F.when(e % 19 == 0, F.substring(line, 1, 40)).otherwise(line).alias("value"))


def stuttered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of each part's type and brand, by key with words that come again, alike or nearly so."""
    k = F.col("p_partkey")
    words, n = F.split(F.concat_ws(" ", "p_type", "p_brand"), " "), F.size("words")
    last, first = F.element_at("words", -1), F.element_at("words", 1)
    tail = F.when(k % 6 == 1, F.array(last, last)).when(k % 6 == 2, F.slice("words", n - 1, 2)).when(k % 6 == 3, F.array(F.concat(F.lower(first), F.lit(".")))).when(k % 6 == 4, F.array(F.concat(first, F.lit("Y")), F.lit("-"))).when(k % 6 == 5, F.concat(F.col("words"), F.col("words")))
    return read(spark, sf_dir, "part").select("p_partkey", words.alias("words")).select("p_partkey", F.concat("words", F.coalesce(tail, F.array().cast("array<string>"))).alias("words"))


def papers(spark: SparkSession, sf_dir: str) -> str:
    """A folder with a file for each supplier: a few lines of a quotation, by key of another kind or unreadable."""
    k = F.col("s_suppkey")
    text = F.concat(F.lit("Horse Power : "), 15 + k % 100, F.lit(" HP\nGrand Total : "), 100_000 + 137 * k)
    content = F.when(k % 10 == 4, F.unhex(F.lit("FFFE00"))).when(k % 10 == 6, F.encode(F.lit(" "), "utf-8")).otherwise(F.encode(text, "utf-8"))
    name = F.concat(F.lit("paper-"), k, F.when(k % 10 == 3, ".txt").when(k % 2 == 0, ".PNG").otherwise(".pdf"))
    folder = new_path(spark, "papers")
    images.write_files(read(spark, sf_dir, "supplier").select(name.alias("name"), content.alias("content")), folder)
    return folder


def packets(spark: SparkSession, sf_dir: str) -> str:
    """A folder with a PDF file of one to four pages for each supplier: on one of them a quotation, on even ones a scan."""
    k = F.col("s_suppkey")
    plans = read(spark, sf_dir, "supplier").select("s_suppkey", "s_name", (1 + k % 4).cast("int").alias("n"), (k % 3).cast("int").alias("at"), (20 + k % 7).cast("int").alias("width"))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            texts = [[f"{'Quotation' if page == r['at'] else 'Terms'} of {r['s_name']} ({page})\nGrand Total: {100000 + r['s_suppkey']}" if page == r["at"] else f"Terms of {r['s_name']} ({page})" for page in range(r["n"])] for r in rows]
            files = [pdf.write([(text, np.full((10, r["width"], 3), page, np.uint8) if page % 2 == 0 else None) for page, text in enumerate(own)]) for r, own in zip(rows, texts)]
            yield pa.RecordBatch.from_arrays([pa.array([f"packet-{r['s_suppkey']}.pdf" for r in rows]), pa.array(files, pa.binary())], ["name", "content"])

    folder = new_path(spark, "packets")
    images.write_files(plans.mapInArrow(draw, "name string, content binary"), folder)
    return folder
