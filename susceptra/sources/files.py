"""Scans and sinks of the domain's files. Nothing is inferred, so no file is read twice; columns prune at the scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from susceptra.functions.sequence import wrap
from susceptra.operators.relational import first_in_group

#: One optional column of a hit table and the names it goes by.
HIT_COLUMNS = {"symbol": ("Element symbol", "Gene symbol"), "type": ("Type", "Element type"), "subtype": ("Subtype", "Element subtype"), "class": ("Class",), "subclass": ("Subclass",), "method": ("Method",)}
REPORT_SCHEMA = "accession string, organism struct<organism_name: string>, assembly_info struct<biosample: struct<accession: string>>, assembly_stats struct<number_of_contigs: long, total_sequence_length: string>"
PAF_SCHEMA = "query string, query_length long, qs long, qe long, strand string, donor string, donor_length long, ts long, te long, matches long, block long, quality int"


def text_table(spark: SparkSession, path: str, sep: str = ",", names: list[str] | None = None, comment: str | None = None) -> DataFrame:
    """A delimited file as text columns, absent values as empty strings.

    names: the columns of a file without a header. comment: lines that start with it are skipped.
    """
    reader = spark.read.option("sep", sep).option("inferSchema", False).option("escape", '"')
    if comment:
        reader = reader.option("comment", comment)
    if names:
        found = reader.schema(T.StructType([T.StructField(n, T.StringType()) for n in names])).csv(path)
    else:
        found = reader.option("header", True).csv(path)
    return found.na.fill("")


def versioned_tables(spark: SparkSession, folder: str, schema: str, sep: str = ",") -> DataFrame:
    """All files <standard>_<year>.csv of a folder, plus standard (upper case) and effective_year; other names are skipped."""
    name = F.col("_metadata.file_name")
    pattern = r"^([A-Za-z]+)_([0-9]{4})\.csv$"
    found = spark.read.schema(schema).option("header", True).option("sep", sep).csv(folder)
    named = found.select("*", F.upper(F.regexp_extract(name, pattern, 1)).alias("standard"), F.regexp_extract(name, pattern, 2).alias("effective_year"))
    return named.filter("standard <> ''").withColumn("effective_year", F.col("effective_year").cast("int"))


def assembly_reports(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines (plain or gzip) -> (accession, organism, biosample, contigs, length); rows without a biosample go."""
    found = spark.read.schema(REPORT_SCHEMA).json(path)
    out = found.select("accession", F.col("organism.organism_name").alias("organism"), F.col("assembly_info.biosample.accession").alias("biosample"), F.col("assembly_stats.number_of_contigs").alias("contigs"), F.col("assembly_stats.total_sequence_length").cast("long").alias("length"))
    return out.filter("biosample is not null")


def fasta(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """SC9: (file, header, sequence): a-z raised, lines joined. A '>' inside a header is kept.

    Records without a sequence go; with strict they raise when they are read, and a file without a byte raises at once.
    """
    if strict and (empty := _empty_files(spark, path)):
        raise ValueError(f"empty FASTA: {', '.join(empty)}")
    records = spark.read.option("lineSep", "\n>").text(path).select(F.col("_metadata.file_name").alias("file"), F.regexp_replace("value", r"^>", "").alias("record"))
    header = F.regexp_replace(F.substring_index("record", "\n", 1), r"\s+$", "")
    body = F.expr("substring(record, length(substring_index(record, '\\n', 1)) + 1)")
    sequence = F.translate(F.regexp_replace(body, r"\s", ""), "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    found = records.select("file", header.alias("header"), sequence.alias("sequence"))
    if strict:
        refused = F.raise_error(F.concat(F.lit("empty FASTA: "), "file", F.lit(" "), "header")).cast("string")
        return found.withColumn("sequence", F.when(F.col("sequence") == "", refused).otherwise(F.col("sequence")))
    return found.filter("sequence <> ''")


def _empty_files(spark: SparkSession, path: str) -> list[str]:
    """Files of no bytes at the path, of which Spark's readers know nothing; names and sizes only are listed."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = root.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [x for s in (system.globStatus(root) or []) for x in (system.listStatus(s.getPath()) if s.isDirectory() else [s])]
    return [x.getPath().getName() for x in found if x.isFile() and x.getLen() == 0]


def write_fasta(records: DataFrame, path: str, width: int = 80) -> None:
    """(header, sequence) -> text files of records wrapped at width. Never overwrites."""
    records.select(F.concat(F.lit(">"), F.col("header"), F.lit("\n"), F.rtrim(wrap(F.col("sequence"), width))).alias("value")).write.mode("errorifexists").text(path)


def hits(spark: SparkSession, path: str) -> DataFrame:
    """A hit table under fixed names, whichever of its names a column goes by; absent optional columns are empty."""
    found = text_table(spark, path, "\t")
    known = {c: next((n for n in names if n in found.columns), None) for c, names in HIT_COLUMNS.items()}
    if known["symbol"] is None:
        raise ValueError(f"none of the columns {HIT_COLUMNS['symbol']} in {path}")
    return found.select(*[(F.col(f"`{n}`") if n else F.lit("")).alias(c) for c, n in known.items()])


def class_table(tables: list[DataFrame]) -> DataFrame:
    """(symbol, class) tables -> one row per symbol, of the last table that names it; empty classes go first."""
    ranked = [t.select("symbol", "class", F.lit(i).alias("rank")) for i, t in enumerate(tables)]
    both = ranked[0]
    for more in ranked[1:]:
        both = both.unionByName(more)
    return first_in_group(both.filter("class <> ''"), ["symbol"], F.col("rank").desc(), F.col("class")).select("symbol", "class")


def alignments(spark: SparkSession, path: str, least_length: int = 500, least_identity: float = 0.80, offsets: dict[str, int] | None = None) -> DataFrame:
    """SC15: a PAF file's alignments of the least length and identity; on the reverse strand donor places count from the other end.

    offsets say where a query that is a part of a sequence (left, right, a tile) starts in it: qs and qe count from the
    sequence's start then. Columns fit `candidates.anchored`, whose part is the query's name.
    """
    found = spark.read.schema(PAF_SCHEMA).option("sep", "\t").option("mode", "PERMISSIVE").csv(path)
    kept = found.withColumn("identity", F.col("matches") / F.greatest(F.col("block"), F.lit(1))).filter((F.col("qe") - F.col("qs") >= least_length) & (F.col("identity") >= least_identity))
    back = F.col("strand") == "-"
    start, end = F.when(back, F.col("donor_length") - F.col("te")).otherwise(F.col("ts")), F.when(back, F.col("donor_length") - F.col("ts")).otherwise(F.col("te"))
    shift = F.lit(0)
    for name, offset in (offsets or {}).items():
        shift = F.when(F.col("query") == name, offset).otherwise(shift)
    return kept.select("donor", "strand", "query", (F.col("qs") + shift).alias("qs"), (F.col("qe") + shift).alias("qe"), start.alias("ts"), end.alias("te"), "donor_length", "identity")


def alignments_by_donor(found: DataFrame) -> DataFrame:
    """SC15: alignments -> (donor, strand, hits): a group's alignments in the order of the query, bounded by what an aligner reports for one query."""
    hit = F.struct("qs", "qe", "ts", "te", "identity", "query")
    return found.groupBy("donor", "strand").agg(F.array_sort(F.collect_list(hit)).alias("hits"))


def biosamples(spark: SparkSession, path: str, wanted: list[str]) -> tuple[DataFrame, DataFrame]:
    """SC8: BioSample XML -> (biosample, one column per wanted attribute) and (biosample, cells) with a row per antibiogram row.

    An attribute goes by its harmonised name, else by its own; cells maps normalised header names to values, of tables
    whose class starts with Antibiogram.
    """
    named = "_attribute_name string, _harmonized_name string, _VALUE string"
    cells = "struct<Cell: array<string>>"
    table = f"struct<_class: string, Header: {cells}, Body: struct<Row: array<{cells}>>>"
    schema = f"Ids struct<Id: array<struct<_db: string, _VALUE: string>>>, Attributes struct<Attribute: array<struct<{named.replace(' string', ': string')}>>>, Description struct<Comment: struct<Table: array<{table}>>>"
    found = spark.read.format("xml").option("rowTag", "BioSample").schema(schema).load(path)
    own = F.filter("Ids.Id", lambda i: i["_db"] == "BioSample")
    found = found.withColumn("biosample", F.get(own, F.lit(0))["_VALUE"]).filter("biosample is not null")
    pairs = found.select("biosample", F.explode_outer("Attributes.Attribute").alias("a")).select("biosample", F.coalesce("a._harmonized_name", "a._attribute_name").alias("name"), F.col("a._VALUE").alias("value"))
    attributes = pairs.groupBy("biosample").pivot("name", wanted).agg(F.first("value", ignorenulls=True))
    tables = found.select("biosample", F.explode("Description.Comment.Table").alias("t")).filter(F.startswith(F.col("t._class"), F.lit("Antibiogram")))
    header = F.transform("t.Header.Cell", lambda c: F.regexp_replace(F.lower(F.trim(c)), " ", "_"))
    rows = tables.select("biosample", header.alias("header"), F.explode("t.Body.Row").alias("row")).select("biosample", F.map_from_arrays("header", F.col("row.Cell")).alias("cells"))
    return attributes, rows


def sparse_matrix(spark: SparkSession, path: str, n_rows: int, n_columns: int) -> DataFrame:
    """SC13: (row, column, value) of a long file; a place outside of the stated shape raises when it is read."""
    found = spark.read.option("header", True).schema("row int, column int, value int").csv(path)
    fits = F.col("row").between(0, n_rows - 1) & F.col("column").between(0, n_columns - 1)
    return found.filter(F.assert_true(fits, F.lit("a place outside of the matrix's shape")).isNull())


def mapping_table(spark: SparkSession, lines: DataFrame) -> DataFrame:
    """SC14: (key, value) of the flat `key: value` lines of a YAML dimension; comments and blank lines go, quotes are taken off."""
    kept = lines.select(F.regexp_replace("value", r"\s+#.*$|^#.*$", "").alias("value")).filter("trim(value) <> ''")
    strip = lambda c: F.regexp_replace(F.trim(c), "^[\"']|[\"']$", "")
    return kept.select(strip(F.substring_index("value", ":", 1)).alias("key"), strip(F.expr("substring(value, instr(value, ':') + 1)")).alias("value"))


def reference_bank(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """SC21: manifest (file, sha256, length) against the files -> (file, header, length, reason): missing_file, checksum_differs, not_one_record, length_differs or null."""
    blob = spark.read.format("binaryFile").load(path)
    text = F.decode("content", "UTF-8")
    records = F.filter(F.split(F.concat(F.lit("\n"), text), "\n>"), lambda r: F.trim(r) != "")
    first = F.get(records, F.lit(0))
    seen = blob.select(
        F.element_at(F.split("path", "/"), -1).alias("file"), F.sha2("content", 256).alias("__sha"), F.size(records).alias("__n"),
        F.trim(F.substring_index(first, "\n", 1)).alias("header"), F.length(F.regexp_replace(F.substring(first, F.length(F.substring_index(first, "\n", 1)) + 1, F.length(first)), r"\s", "")).alias("__length"),
    )
    j = manifest.join(seen, "file", "left")
    reason = F.when(F.col("__sha").isNull(), "missing_file").when(F.col("__sha") != F.col("sha256"), "checksum_differs").when(F.col("__n") != 1, "not_one_record").when(F.col("__length") != F.col("length"), "length_differs")
    return j.select("file", "header", F.col("__length").alias("length"), reason.alias("reason"))


def bank_candidates(records: DataFrame, least: int = 1_000_000) -> DataFrame:
    """SC22: (file, header, sequence) -> the files' only records that are no plasmid and longer than least; other files go."""
    own = records.filter(~F.contains(F.lower("header"), F.lit("plasmid")) & (F.length("sequence") > least))
    one = own.groupBy("file").agg(F.count(F.lit(1)).alias("n")).filter("n = 1").select("file")
    return own.join(one, "file", "left_semi")
