"""Source-code corpora derived from the relational tables.

The text of every file follows from rows of the tables, so what an extractor finds can be
checked against these rows. Each corpus is (path, content).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _text(template: str, **values: Column) -> Column:
    """Template with ``{name}`` placeholders as one concatenation."""
    pieces: list[Column] = []
    rest = template
    while rest:
        cut = min((rest.find("{" + n + "}") for n in values if "{" + n + "}" in rest),
                  default=-1)
        if cut < 0:
            pieces.append(F.lit(rest))
            break
        if cut:
            pieces.append(F.lit(rest[:cut]))
        name = rest[cut + 1:rest.index("}", cut)]
        pieces.append(values[name].cast("string"))
        rest = rest[cut + len(name) + 2:]
    return F.concat(*pieces)


def _spread(rows: DataFrame, key: str) -> DataFrame:
    """Narrow rows over all tasks by key: the texts made from them are far larger and take
    more work than the size of the rows lets Spark expect."""
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(partitions, key)


def _import_lines(pairs: DataFrame, key: str, target: str, template: str) -> DataFrame:
    """(key, imports): one import line per distinct target, in target order. Spread by key
    once, for both steps."""
    return _spread(pairs.select(key, target), key).distinct().groupBy(key).agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(target)), lambda k: _text(template, k=k)),
            "",
        ).alias("imports")
    )


ORDER_FILE = """import fs from "fs";
{imports}
export function tax{n}(net: number): number {
  return net / {n};
}
type Due{n} = Date;
interface Basket{n} {
  lines: string[];
}
interface Sealed{n} {
}
"""
PART_FILE = """{imports}export type Size{n} = {size};
"""
SUPPLIER_FILE = """import nation from "./nation{nation}";
{imports}export const name{n} = "{name}";
"""


def ts_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders import their parts, parts their suppliers, suppliers their first part (a
    cycle) and a nation file that does not exist."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    none = F.lit("")
    orders = _spread(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey").join(
        _import_lines(items, "l_orderkey", "l_partkey", 'import { p{k} } from "../parts/p{k}";\n'),
        F.col("o_orderkey") == F.col("l_orderkey"), "left",
    ).select(
        F.concat(F.lit("src/orders/o"), "o_orderkey", F.lit(".ts")).alias("path"),
        _text(ORDER_FILE, n=F.col("o_orderkey"),
              imports=F.coalesce("imports", none)).alias("content"),
    )
    sizes = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    parts = _spread(sizes, "p_partkey").join(
        _import_lines(items, "l_partkey", "l_suppkey",
                      'import { s{k} } from "../supp/s{k}.js";\n'),
        F.col("p_partkey") == F.col("l_partkey"), "left",
    ).select(
        F.concat(F.lit("src/parts/p"), "p_partkey", F.lit(".ts")).alias("path"),
        _text(PART_FILE, n=F.col("p_partkey"), size=F.col("p_size"),
              imports=F.coalesce("imports", none)).alias("content"),
    )
    first_part = items.groupBy("l_suppkey").agg(F.min("l_partkey").alias("k"))
    suppliers = table(spark, sf_dir, "supplier").join(
        first_part, F.col("s_suppkey") == F.col("l_suppkey"), "left"
    ).select(
        F.concat(F.lit("src/supp/s"), "s_suppkey", F.lit(".js")).alias("path"),
        _text(
            SUPPLIER_FILE, n=F.col("s_suppkey"), nation=F.col("s_nationkey"),
            name=F.col("s_name"),
            imports=F.coalesce(
                _text('import back from "../parts/p{k}";\n', k=F.col("k")), none),
        ).alias("content"),
    )
    return orders.unionByName(parts).unionByName(suppliers)


def ts_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of ``ts_modules`` without the work for the contents."""
    def named(source: str, key: str, prefix: str, suffix: str) -> DataFrame:
        return table(spark, sf_dir, source).select(
            F.concat(F.lit(prefix), key, F.lit(suffix)).alias("path"))

    return (
        named("orders", "o_orderkey", "src/orders/o", ".ts")
        .unionByName(named("part", "p_partkey", "src/parts/p", ".ts"))
        .unionByName(named("supplier", "s_suppkey", "src/supp/s", ".js"))
    )


JS_FILE = """/* Depot {n}: {name}
   opened once */
exports.depth{n} = {n} * 2;
import { stat } from 'node:fs';
export let label{n} = "{name}";
const tally = require('./tally-{n}');
async function measure{n}(shelf) { return shelf; }
export function weigh{n}(crate, tare) { return crate - tare; }
var loose{n} = require('loose');
module.exports = { weigh{n}, heavy{n}: weigh{n},
  limit{n} };
export var site{n} = "ftp://depot/{n}";
// closing time of {n}
module.exports.close{n} = shelf => shelf.length;
"""


def js_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("js/m"), "s_suppkey", F.lit(".js")).alias("path"),
        _text(JS_FILE, n=F.col("s_suppkey"), name=F.col("s_name")).alias("content"),
    )


JAVA_FILE = """package freight;

import freight.kind.{type};
import java.time.Instant;

interface Tariff{n} {
    Money quote{n}(Route route);
}

@Tracked
@Label("{name}")
public class Crate{n} {
    class Seal{n} {
        Instant closed;
    }

    @Audited
    public void ship{n}(
        Route route,
        Instant start
    ) {
        log(route);
    }

    private int size = {size};

    @Cached(minutes = 5)
    public long volume{n}() {
        return cube(size);
    }

    public Crate{n}(Route home) {
        register(home);
    }
}
"""


def java_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spread(table(spark, sf_dir, "part"), "p_partkey").select(
        F.concat(F.lit("java/P"), "p_partkey", F.lit(".java")).alias("path"),
        _text(JAVA_FILE, n=F.col("p_partkey"), name=F.col("p_name"), type=F.col("p_type"),
              size=F.col("p_size")).alias("content"),
    )


def jsp_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(
        F.concat(F.lit("pages/p"), "page_id", F.lit(".jsp")).alias("path"),
        F.concat(F.lit("<%= "), "page_id", F.lit(" %>"), "html").alias("content"),
    )


def document_files(spark: SparkSession, sf_dir: str, suffix: str = ".txt") -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.concat("source", F.lit("/"), "lang", F.lit("/d"), "doc_id", F.lit(suffix))
        .alias("path"),
        F.col("text").alias("content"),
    )


def markdown_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as sections with a heading each."""
    return table(spark, sf_dir, "conversations").select(
        F.concat(F.lit("talks/c"), "conv_id", F.lit("-"), "turn", F.lit(".md")).alias("path"),
        F.concat(F.lit("# Talk "), "conv_id", F.lit("\n\n## "), "role", F.lit("\n\n"), "text")
        .alias("content"),
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requested paths (position, path): order files, every tenth under a wrong name."""
    key = F.col("o_orderkey")
    name = F.concat(F.lit("src/orders/o"), key, F.when(key % 10 == 0, ".old").otherwise(".ts"))
    return table(spark, sf_dir, "orders").select(key.alias("position"), name.alias("path"))


def model_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses (path, response) of a model: JSON with each document as the answer; some
    answers are not relevant, some have an error or a search, some are cut short."""
    key = F.col("doc_id")
    valid = F.to_json(F.struct(
        F.when(key % 5 == 0, "Not relevant.").otherwise(F.col("text")).alias("answer"),
        F.array(F.concat(F.lit("d"), key + 1), F.concat(F.lit("d"), key * 2))
        .alias("neededFiles"),
        F.when(key % 11 == 0, F.concat(F.lit("failed "), key)).alias("error"),
        F.when(key % 3 == 0, F.struct(
            F.concat(F.lit("d"), key).alias("regex"), F.lit("i").alias("flags"),
            F.array(F.lit(".txt")).alias("fileTypes"))).alias("searchForUsage"),
    ))
    broken = F.concat(F.lit('{"answer": "cut '), key)
    no_files = F.concat(F.lit('{"answer": "alone '), key, F.lit('"}'))
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("d"), key).alias("path"),
        F.when(key % 7 == 0, broken).when(key % 13 == 0, no_files).otherwise(valid)
        .alias("response"),
    )


def numbered_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Free text with four numbered sections from conversation turns; longer talks lack the
    last one."""
    turn = table(spark, sf_dir, "conversations")
    return turn.select(
        "conv_id", "turn",
        F.concat(
            F.lit("Notes\n1. Explanation\n  by "), "role", F.lit(" \n2. Use case\nturn "), "turn",
            F.lit("\n3. Abstraction\ntalk "), "conv_id", F.lit("\n"),
            F.when(F.col("turn") % 4 == 3, "end").otherwise(
                F.concat(F.lit("4. Functions\n"), F.lit("f"), F.col("conv_id"), F.lit("\n"))),
        ).alias("text"),
    )
