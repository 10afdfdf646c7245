"""File trees as inventory rows: one select over the binary-file source."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from folioflow.functions.ids import file_id

# Suffixes, media types and path marks.
IMAGES = (".jpg", ".jpeg", ".png", ".tif", ".tiff", ".bmp", ".webp")
PDFS = (".pdf",)
ARCHIVES = (".zip", ".tar", ".gz", ".7z", ".rar")
MIME = {
    ".json": "application/json", ".txt": "text/plain", ".csv": "text/csv", ".xml": "application/xml", ".bin": "application/octet-stream", ".zip": "application/zip",
    ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".png": "image/png", ".tif": "image/tiff", ".tiff": "image/tiff", ".bmp": "image/bmp", ".webp": "image/webp", ".pdf": "application/pdf",
}
PRIVATE_MARKS = ("gmail", "private", "legal_financial_docs")
PUBLIC_MARKS = ("data/raw/public", "public_train")
CATEGORIES = {"sroie": "receipt", "funsd": "form", "fatura": "invoice"}
CORU_CATEGORIES = (("ocr dataset", "OCR_annotation"), ("item information extraction", "field_annotation"), ("receipt question answering", "question_answer"))
COLUMNS = (
    "file_id", "dataset", "document_category", "original_filename", "current_relative_path", "original_relative_path", "extension", "mime_type", "size_bytes", "modified_time", "sha256",
    "is_private", "is_annotation", "is_image", "is_pdf", "is_readable", "is_empty", "document_key", "notes",
)


def slashes(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def _any(text: Column, marks) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(m)) for m in marks])


def is_private(path: Column) -> Column:
    return _any(F.lower(slashes(path)), PRIVATE_MARKS)


def is_public(path: Column) -> Column:
    return _any(F.lower(slashes(path)), PUBLIC_MARKS)


def not_private_in_public(path: Column) -> Column:
    """The path; an error where a private file lies in a public tree."""
    return F.when(is_private(path) & is_public(path), F.raise_error(F.lit("private file in a public tree"))).otherwise(path)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))


def stem(path: Column) -> Column:
    name = F.substring_index(slashes(path), "/", -1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def component(dataset: Column, path: Column) -> Column:
    return F.coalesce(F.try_element_at(F.split(slashes(path), "/"), F.lit(2)), dataset)


def original_split(dataset: Column, path: Column) -> Column:
    parts = F.split(F.lower(slashes(path)), "/")
    has = lambda s: F.array_contains(parts, s)
    form = F.when(has("training_data"), "train").when(has("testing_data"), "test")
    plain = F.when(has("train"), "train").when(has("validation") | has("val"), "validation").when(has("test"), "test").when(has("dev"), "validation").otherwise("unspecified")
    return F.when(dataset == "funsd", F.coalesce(form, plain)).otherwise(plain)


def document_key(dataset: Column, path: Column) -> Column:
    return F.when(dataset == "coru", F.concat_ws("/", F.element_at(F.split(slashes(path), "/"), 1), stem(path))).otherwise(stem(path))


def template_family(dataset: Column, name: Column) -> Column:
    m = F.lower(F.regexp_extract(name, r"^(Template[^_]+)", 1))
    return F.when(dataset != "fatura", "").when(m != "", m).otherwise("unknown")


def category(dataset: Column, path: Column, ext: Column) -> Column:
    low = F.lower(slashes(path))
    coru = F.lit(None).cast("string")
    for mark, name in reversed(CORU_CATEGORIES):
        coru = F.when(F.contains(low, F.lit(mark)), F.lit(name)).otherwise(coru)
    coru = F.coalesce(coru, F.when(F.contains(low, F.lit("receipt images & key information detection")) & ext.isin(".txt", ".json"), "field_annotation"), F.lit("receipt"))
    out = F.when(dataset == "coru", coru)
    for name, cat in CATEGORIES.items():
        out = out.when(dataset == name, cat)
    return out.otherwise("unknown")


def filename_category(name: Column, groups: list[tuple[str, tuple[str, ...]]]) -> Column:
    """The first group with a word in the file name; their order decides."""
    low = F.lower(name)
    out = F.lit("unclassified")
    for label, words in reversed(groups):
        out = F.when(_any(low, words), F.lit(label)).otherwise(out)
    return out


def safe_path(path: Column, fid: Column) -> Column:
    """The path, with the file's name replaced by its id where it is private."""
    parent = F.regexp_extract(slashes(path), r"^(.*)/[^/]*$", 1)
    name = F.concat(fid, extension(path))
    return F.when(is_private(path), F.when(parent != "", F.concat_ws("/", parent, name)).otherwise(name)).otherwise(path)


def rows_from_files(files: DataFrame, dataset: Column, root: str) -> DataFrame:
    """Inventory rows of (path, modificationTime, length, content); content is read once.

    A JSON file that doesn't parse and a CSV, XML or text file that isn't UTF-8
    get a note; empty files are unreadable.  Pixel checks are not made here.
    """
    rel = F.regexp_replace("path", "^.*?" + re.escape(root.strip("/")) + "/", "")
    f = files.select("modificationTime", "length", "content", rel.alias("rel"), dataset.alias("dataset")).withColumn("ext", extension(F.col("rel")))
    text = F.decode("content", "utf-8")
    utf8 = F.is_valid_utf8(F.col("content").cast("string"))
    bad_json = (F.col("ext") == ".json") & (~utf8 | F.try_parse_json(F.when(utf8, text)).isNull()) & (F.col("length") > 0)
    odd_text = F.col("ext").isin(".txt", ".xml", ".csv") & ~utf8
    low = F.lower("rel")
    notes = F.array_compact(F.array(
        F.when(F.col("length") == 0, "empty file"), F.when(bad_json, "invalid_json"), F.when(odd_text, "txt:non-utf8"), F.when(F.col("ext").isin(*ARCHIVES), "archive (not extracted)"),
        F.when(F.contains(low, F.lit(".ds_store")) | F.contains(low, F.lit("__macosx")), "OS junk"),
    ))
    mime = F.lit("application/octet-stream")
    for e, m in MIME.items():
        mime = F.when(F.col("ext") == e, m).otherwise(mime)
    annotation = F.col("ext").isin(".json", ".xml", ".csv") | ((F.col("ext") == ".txt") & _any(low, ("annot", "label", "box", "entit", "gt")))
    return f.select(
        file_id(F.col("dataset"), F.col("rel")).alias("file_id"), "dataset", category(F.col("dataset"), F.col("rel"), F.col("ext")).alias("document_category"), F.substring_index("rel", "/", -1).alias("original_filename"),
        F.concat_ws("/", "dataset", "rel").alias("current_relative_path"), F.col("rel").alias("original_relative_path"), F.col("ext").alias("extension"), mime.alias("mime_type"), F.col("length").alias("size_bytes"),
        F.col("modificationTime").alias("modified_time"), F.when(F.col("length") > 0, F.sha2("content", 256)).otherwise("").alias("sha256"), is_private(F.col("rel")).alias("is_private"), annotation.alias("is_annotation"),
        F.col("ext").isin(*IMAGES).alias("is_image"), F.col("ext").isin(*PDFS).alias("is_pdf"), ((F.col("length") > 0) & ~F.coalesce(bad_json, F.lit(False))).alias("is_readable"), (F.col("length") == 0).alias("is_empty"),
        document_key(F.col("dataset"), F.col("rel")).alias("document_key"), F.array_join(notes, "; ").alias("notes"),
    )


def empty_files(spark: SparkSession, root: str) -> DataFrame:
    """Files without a byte, which the binary-file source passes over, in its columns.

    Listing a tree is a task of the driver in any case; only the empty files'
    names are kept.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(root)
    listed = path.getFileSystem(conf).listFiles(path, True)
    rows = []
    while listed.hasNext():
        f = listed.next()
        if f.getLen() == 0:
            rows.append((f.getPath().toString(), f.getModificationTime()))
    made = spark.createDataFrame(rows, "path string, ms bigint")
    return made.select("path", F.timestamp_millis("ms").alias("modificationTime"), F.lit(0).cast("bigint").alias("length"), F.lit("").cast("binary").alias("content"))


def inventory(spark: SparkSession, root: str, dataset: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).unionByName(empty_files(spark, root))
    return rows_from_files(files, F.lit(dataset), root.removeprefix("file://"))


def error_type(notes: Column, is_image: Column) -> Column:
    n = F.lower(notes)
    has = lambda w: F.contains(n, F.lit(w))
    return F.when(has("invalid_json"), "invalid_json").when(has("invalid_csv"), "invalid_csv").when(has("pdf"), "corrupted_pdf").when((has("corrupted") & is_image) | has("non-positive image"), "corrupted_image").otherwise("unreadable_file")


def tree_digest(inv: DataFrame) -> DataFrame:
    """One digest of all (path, digest) pairs in path order; a bounded-size list per bucket of paths.

    Paths are hashed in 4096 buckets whose digests are joined, so no task or
    row holds the whole tree.
    """
    line = F.concat_ws("\x00", "original_relative_path", "sha256")
    each = inv.groupBy(F.pmod(F.xxhash64("original_relative_path"), F.lit(4096)).alias("b")).agg(F.count(F.lit(1)).alias("n"), F.sum("size_bytes").alias("bytes"), F.sha2(F.array_join(F.sort_array(F.collect_list(line)), "\n"), 256).alias("d"))
    return each.agg(F.sum("n").alias("files"), F.sum("bytes").alias("bytes"), F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("b", "d"))), lambda s: s.d), "\n"), 256).alias("digest"))


def compare_trees(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Paths that are missing, added or changed between two inventories."""
    e, a = expected.select("original_relative_path", F.col("sha256").alias("e")), actual.select("original_relative_path", F.col("sha256").alias("a"))
    j = e.join(a, "original_relative_path", "full")
    return j.where("NOT e <=> a").select("original_relative_path", F.when(F.col("a").isNull(), "missing").when(F.col("e").isNull(), "added").otherwise("changed").alias("status"))
