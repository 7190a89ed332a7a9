"""License scans: sparse TF-IDF cosine of a file's lines to licence templates, then inheritance along directories.

Every line of every file and every run of up to WINDOW lines is a header candidate, and every file also counts as a whole. The weights' document
frequencies are counted over all files. A candidate is compared in full only if an upper bound of its cosine, summed up
from its words one by one, reaches the least. A file without a licence of its own takes that of the nearest directory
above it (its own first) that holds a licence file; directories are met by equi-joins on their ancestors' paths.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, documents, lean
from .licence_texts import TEMPLATES

#: Name of a licence to its texts.
Templates = Mapping[str, str | Sequence[str]]
LEAST = 0.6
#: Lines up to which a run of them is compared as one.
WINDOW = 4
#: Directories with a licence up to which their table is broadcast.
BROADCAST_ROWS = 200_000
WORD = re.compile(r"[^\W_]+")
LICENCE_FILE = r"(?i)(^|/)(licen[cs]e|copying|notice)[^/]*$"


def terms(text: str) -> list[str]:
    return WORD.findall(text.lower())


def texts_of(templates: Templates) -> list[tuple[str, str]]:
    """Name and text of each template, by name and then in the order given."""
    return [(name, text) for name, texts in sorted(templates.items()) for text in ([texts] if isinstance(texts, str) else texts)]


def document_frequencies(files: DataFrame, templates: Templates, text_col: str = "text") -> tuple[int, dict[str, int]]:
    """The number of files, and in how many each word of the templates occurs: one pass over all whole texts."""
    vocabulary = {t for _, x in texts_of(templates) for t in terms(x)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, counts = 0, Counter()
        for batch in batches:
            for text in batch.column(0):
                n += 1
                counts.update(vocabulary.intersection(terms(text.as_py() or "")))
        counts[""] = n
        yield pa.RecordBatch.from_arrays([pa.array(list(counts)), pa.array(list(counts.values()), pa.int64())], ["term", "n"])

    counted = files.select(F.col(text_col).cast("string")).mapInArrow(lean(run), "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))
    found = {r["term"]: r["n"] for r in counted.collect()}  # at most as many rows as the templates have words
    return found.pop("", 0), found


class Matcher:
    def __init__(self, templates: Templates, n: int, frequencies: dict[str, int], least: float = LEAST) -> None:
        given = [(name, terms(text)) for name, text in texts_of(templates)]
        self.least = least
        self.rare = math.log((n + 1) / 1) + 1  # of words that no template has; their weight only lengthens a line
        self.idf = {t: math.log((n + 1) / (frequencies.get(t, 0) + 1)) + 1 for _, words in given for t in words}
        self.names: list[str] = []
        self.vectors: list[dict[str, float]] = []
        for name, words in given:
            weights = {t: k * self.idf[t] for t, k in Counter(words).items()}
            norm = math.sqrt(sum(w * w for w in weights.values()))
            self.names.append(name)
            self.vectors.append({t: w / norm for t, w in weights.items()} if norm else {})
        #: Most that one occurrence of a word adds to the dot product with any template; least that it adds to the square of the norm.
        self.adds = {t: w * max(v.get(t, 0.0) for v in self.vectors) for t, w in self.idf.items()}
        self.squares = {t: w * w for t, w in self.idf.items()}

    def best(self, words: list[str]) -> tuple[float, str | None]:
        """The highest cosine and its template (ties: the first by name); 0 and None if no word is shared."""
        counts = Counter(words)
        weights = {t: k * self.idf[t] for t, k in counts.items() if t in self.idf}
        if not weights:
            return 0.0, None
        other = sum(k * k for t, k in counts.items() if t not in self.idf)
        norm = math.sqrt(sum(w * w for w in weights.values()) + other * self.rare**2)
        scores = [math.fsum(w * v.get(t, 0.0) for t, w in weights.items()) / norm for v in self.vectors]
        top = max(scores)
        return top, self.names[scores.index(top)]

    def file(self, text: str | None) -> tuple[float, str | None, int | None]:
        """The best line, run of lines or whole file (line 0) with its cosine, template and number (of its first line) from 1.

        Ties go to what starts first, then to what is shorter, and the whole file comes last; only what reaches the least counts. A run
        starts and ends with a line that shares a word with a template; others could only lengthen it. The bound: counts
        of a word add up in the dot product, and their squares are no less than the counts, so no cosine exceeds the sum
        of what its words add over the root of the sum of their least squares.
        """
        found: tuple[float, str | None, int | None] = (0.0, None, None)
        if not text:
            return found
        lines = [terms(line) for line in text.split("\n")]
        adds = np.array([sum(map(self.adds.get, words, [0.0] * len(words))) for words in lines])
        if not adds.any():
            return found
        squares = np.array([sum(map(self.squares.get, words, [self.rare**2] * len(words))) for words in lines])
        limit = (self.least - 1e-9) ** 2
        tried: list[tuple[int, int]] = []
        for size in range(min(WINDOW, len(lines))):
            n = len(lines) - size
            a, b = sum(adds[k : k + n] for k in range(size + 1)), sum(squares[k : k + n] for k in range(size + 1))
            tried += [(int(i), size) for i in np.flatnonzero((a * a >= limit * b) & (adds[:n] > 0) & (adds[size:] > 0))]
        for i, size in sorted(tried):
            score, name = self.best([w for words in lines[i : i + size + 1] for w in words])
            if score >= self.least and score > found[0]:
                found = (score, name, i + 1)
        if adds.sum() ** 2 >= limit * squares.sum() or self._long(lines):
            score, name = self.best([w for words in lines for w in words])
            if score >= self.least and score > found[0]:
                found = (score, name, 0)
        return found

    def _long(self, lines: list[list[str]]) -> bool:
        """The bound of a whole text, where words come up often, by their counts."""
        counts = Counter(w for words in lines for w in words)
        a = sum(k * self.adds.get(t, 0.0) for t, k in counts.items())
        b = sum(k * k * self.squares.get(t, self.rare**2) for t, k in counts.items())
        return a * a >= (self.least - 1e-9) ** 2 * b


def scan(files: DataFrame, path_col: str = "path", text_col: str = "text", templates: Templates | None = None, licence_file=None, least: float = LEAST) -> DataFrame:
    """One row per file row: path, own_license, cosine, line, license, origin ("own", "inherited" or "none"), from_dir.

    licence_file: a column that tells licence files; by default their name does. A directory with several licence
    files takes the one of the highest cosine (ties: the least path). cosine is 0 where nothing reaches the least. Null
    texts are empty; a file with a null path inherits nothing; repeated rows stay; texts of any length are compared
    whole; other columns are ignored, so their names may be any. An empty table gives no rows.
    """
    templates = templates or TEMPLATES
    given = files.select(F.col(path_col).cast("string").alias("path"), F.col(text_col).cast("string").alias("text"), (licence_file if licence_file is not None else F.col(path_col).rlike(LICENCE_FILE)).alias("is_licence"))
    matcher = Matcher(templates, *document_frequencies(given, templates), least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [matcher.file(t.as_py()) for t in batch.column(1)]
            cosines, names, lines = (list(x) for x in zip(*found)) if found else ([], [], [])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(names, pa.string()), pa.array(cosines, pa.float64()), pa.array(lines, pa.int32())], ["path", "is_licence", "own_license", "cosine", "line"])

    own = checkpoint(given.mapInArrow(lean(run), "path string, is_licence boolean, own_license string, cosine double, line int"))
    folder = F.when(F.instr("path", "/") > 0, F.regexp_extract("path", r"^(.*)/[^/]*$", 1)).otherwise(F.when(F.col("path").isNotNull(), F.lit("")))
    placed = own.withColumn("dir", folder)
    licensed = placed.where("is_licence AND own_license IS NOT NULL AND dir IS NOT NULL").groupBy("dir").agg(F.min(F.struct((-F.col("cosine")).alias("c"), "path", "own_license")).alias("x"))
    licensed = licensed.select(F.col("dir").alias("from_dir"), F.col("x.own_license").alias("theirs"))
    needed = placed.where("own_license IS NULL AND dir IS NOT NULL").select("dir").distinct()
    steps = F.split("dir", "/")
    above = F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(steps)), lambda k: F.array_join(F.slice(steps, 1, k), "/")))
    ancestors = needed.select("dir", F.explode(F.array_distinct(above)).alias("from_dir"))
    known = F.broadcast(licensed) if licensed.count() <= BROADCAST_ROWS else licensed
    nearest = ancestors.join(known, "from_dir").groupBy("dir").agg(F.max(F.struct(F.length("from_dir").alias("depth"), "from_dir", "theirs")).alias("x"))
    nearest = checkpoint(nearest.select("dir", "x.from_dir", "x.theirs"))
    known = F.broadcast(nearest) if nearest.count() <= BROADCAST_ROWS else nearest
    out = placed.join(known, "dir", "left")
    inherited = F.col("own_license").isNull() & F.col("theirs").isNotNull()
    return out.select(
        "path", "own_license", "cosine", "line", F.coalesce("own_license", "theirs").alias("license"),
        F.when(F.col("own_license").isNotNull(), "own").when(inherited, "inherited").otherwise("none").alias("origin"),
        F.when(inherited, F.col("from_dir")).alias("from_dir"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as files of a tree source/lang/block of ids; the first id of a block names its licence file."""
    docs = documents(spark, sf_dir)
    name = F.when(F.col("doc_id") % 50 == 0, F.lit("LICENSE-")).otherwise(F.lit(""))
    path = F.concat_ws("/", "source", "lang", F.floor(F.col("doc_id") / 50).cast("string"), F.concat(name, F.col("doc_id").cast("string"), F.lit(".txt")))
    found = scan(docs.select(path.alias("path"), "text"))
    return found.select(F.regexp_extract("path", r"(-?\d+)\.txt$", 1).cast("long").alias("doc_id"), "*")
