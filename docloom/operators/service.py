"""The job service as tables: units, barriers, assignment by priority, resuming, replay of results, back-off; validation, paths, logs of workers, signatures.

State is read from append-only tables by the last row of each key. Windows run within a worker, a book or a name; empty tables give empty results, nulls match nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# States of jobs by kind; seconds of grace for workers of higher priority, of delay before a finished job is cleaned; percentages of the second phase.
ACTIVE, TERMINAL = ("queued", "running", "extraction_done", "processing"), ("completed", "failed", "cancelled")
GRACE, CLEANUP, PHASE_BASE, PHASE_SHARE, PHASE_CAP = 10.0, 300.0, 65, 0.34, 99


def latest(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key: the state after `$set` updates, of which later ones win."""
    others = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("_r")).select(*key, "_r.*")


def applied(rows: DataFrame, key: list[str], order: list[str], set_: list[str], inc: list[str]) -> DataFrame:
    """Documents after updates in order: the last value that isn't null of each field that is set, the sum of each that is incremented."""
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(*order))).alias(c) for c in set_]
    return rows.groupBy(*key).agg(*last, *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in inc))


def barriers(units: DataFrame, book: str = "book_id") -> DataFrame:
    """(book, total, completed, failed, finished, cleanup_at): a book is finished when all its units are completed or failed, and is cleaned some time after the last one."""
    done = F.col("status").isin("COMPLETED", "FAILED")
    rows = units.groupBy(book).agg(F.count("*").alias("total"), F.count_if(F.col("status") == "COMPLETED").alias("completed"), F.count_if(F.col("status") == "FAILED").alias("failed"), F.max(F.when(done, F.col("at"))).alias("_last"))
    finished = F.col("completed") + F.col("failed") == F.col("total")
    return rows.select(book, "total", "completed", "failed", finished.alias("finished"), F.when(finished, F.col("_last") + CLEANUP).alias("cleanup_at"))


def must_wait(requests: DataFrame, workers: DataFrame, pending: DataFrame) -> DataFrame:
    """(request_id, worker, at, wait): whether a worker that asks for a unit waits for idle ones of higher priority (a lower rank): there are some that were seen within the
    grace and hold no unit, and they suffice for all pending units of the kind. `workers` are those on the list of priorities only, ten of each kind in the model: a request is joined
    with as many."""
    asked = requests.select("request_id", F.col("worker").alias("_asker"), "kind", F.col("rank").alias("_rank"), F.col("at").alias("_at"))
    others = workers.select("kind", "worker", "rank", "last_seen", "busy")
    pairs = asked.join(others, "kind", "left")
    idle = (F.col("rank") < F.col("_rank")) & (F.col("_at") - F.col("last_seen") <= GRACE) & ~F.coalesce("busy", F.lit(False))
    counted = pairs.groupBy("request_id", "kind", "_asker", "_at").agg(F.count_if(idle).alias("_idle"))
    left = pending.groupBy("kind").agg(F.sum("n_pending").alias("_pending"))
    rows = counted.join(left, "kind", "left").withColumn("_pending", F.coalesce("_pending", F.lit(0)))
    return rows.select("request_id", F.col("_asker").alias("worker"), F.col("_at").alias("at"), ((F.col("_idle") > 0) & (F.col("_pending") <= F.col("_idle"))).alias("wait"))


def stages_to_run(wanted: DataFrame, status: DataFrame) -> DataFrame:
    """(book_id, stage): the stages of each book that aren't done and have to run when it is resumed."""
    return wanted.join(status.where("status = 'done'").select("book_id", "stage").distinct(), ["book_id", "stage"], "left_anti")


def resumed(status: DataFrame) -> DataFrame:
    """(book_id, stage, status): stages that are done stay so, others are reset to `pending`."""
    return status.select("book_id", "stage", F.when(F.col("status") == "done", "done").otherwise("pending").alias("status"))


def missing(expected: DataFrame, present: DataFrame, key: list[str]) -> DataFrame:
    """The expected keys that aren't present."""
    return expected.select(*key).distinct().join(present.select(*key).distinct(), key, "left_anti")


def replayed(cache: DataFrame, answers: DataFrame) -> DataFrame:
    """(job_id, action) of cached results (job_id, payload) after they were submitted again: `skipped` if the payload is no JSON, in which case it isn't submitted, `cleared` if the service
    answered 200, else `kept`, as without an answer."""
    valid = F.try_parse_json("payload").isNotNull()
    rows = cache.select("job_id", valid.alias("_valid")).join(answers.select("job_id", "http_status"), "job_id", "left")
    action = F.when(~F.coalesce("_valid", F.lit(False)), "skipped").when(F.col("http_status") == 200, "cleared").otherwise("kept")
    return rows.select("job_id", action.alias("action"))


def backoff(attempt: Column, initial: float = 5.0, cap: float = 60.0) -> Column:
    """The delay in seconds before an attempt (counted from 0): doubled each time up to a cap."""
    return F.least(F.lit(initial) * F.pow(F.lit(2.0), attempt), F.lit(cap))


def batch_rollup(results: DataFrame, key: str, counters: list[str]) -> DataFrame:
    """The counters of batch results, summed up for each book."""
    return results.groupBy(key).agg(F.count("*").alias("n_batches"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counters))


def active_by_kind(units: DataFrame, book: str = "book_id") -> DataFrame:
    """(kind, book, n_active): units that are pending or processing by kind and book, with totals by kind and of all (`all`)."""
    rows = units.where(F.col("status").isin("PENDING", "PROCESSING")).rollup("kind", book).agg(F.count("*").alias("n_active"))
    return rows.select(F.coalesce("kind", F.lit("all")).alias("kind"), F.coalesce(F.col(book).cast("string"), F.lit("all")).alias("book"), "n_active")


def phase_percent(first: Column, second: Column) -> Column:
    """The percentage of a job in its second phase, from those of its two branches."""
    return F.least(F.lit(PHASE_BASE) + ((first + second) / 2 * PHASE_SHARE).cast("int"), F.lit(PHASE_CAP))


def validated(uploads: DataFrame, library: DataFrame, jobs: DataFrame) -> DataFrame:
    """(book_id, file_name, problem) of uploads: a bad id, a file that is no PDF, a book that the library has, a job that is active for it; null for none."""
    rows = uploads.join(library.select("book_id", F.lit(True).alias("_has")).distinct(), "book_id", "left")
    rows = rows.join(jobs.where(F.col("status").isin(*ACTIVE)).select("book_id", F.lit(True).alias("_active")).distinct(), "book_id", "left")
    bad = ~F.coalesce(F.col("book_id").rlike(r"^[A-Za-z0-9_\-]+$"), F.lit(False))
    problem = F.when(bad, "bad_id").when(~F.coalesce(F.lower("file_name").endswith(".pdf"), F.lit(False)), "no_pdf").when(F.col("_has"), "duplicate").when(F.col("_active"), "active_job")
    return rows.select("book_id", "file_name", problem.alias("problem"))


def owned(rows: DataFrame, chats: DataFrame, user: str = "user_id") -> DataFrame:
    """Rows (chat_id, user) whose chat exists and is the user's own."""
    return rows.join(chats.select("chat_id", user).distinct(), ["chat_id", user], "left_semi")


def last_lines(logs: DataFrame, size: int = 5000) -> DataFrame:
    """The last `size` log lines of each worker with their place, the newest first; Spark limits each worker before the shuffle."""
    newest = Window.partitionBy("worker_id").orderBy(F.desc("ts"), F.desc("line"))
    return logs.withColumn("place", F.row_number().over(newest)).where(F.col("place") <= size)


def dashboard(workers: DataFrame) -> DataFrame:
    """Workers by address, type and id."""
    return workers.orderBy("ip", "type", "worker_id")


def file_slug(text: Column) -> Column:
    """A name as in file names: runs of other characters as a hyphen, lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"^\s+|\s+$", ""), "[^A-Za-z0-9_-]+", "-"), "^-+|-+$", ""))


def resolved_paths(books: DataFrame, files: DataFrame) -> DataFrame:
    """(book_id, path): the file of each book (book_id, title, stored_path): its stored path, else a file named by the id, its variants or the title, else one whose slug is
    that of one of these; of several the first by path."""
    name = F.regexp_extract("path", r"([^/]+?)(?:\.[Pp][Dd][Ff])?$", 1)
    known = files.select("path", name.alias("name"), file_slug(name).alias("slug"))
    title = F.coalesce("title", F.lit(""))
    names = F.array_distinct(F.array("book_id", file_slug(F.col("book_id")), F.replace("book_id", F.lit("-"), F.lit("_")), F.replace("book_id", F.lit("_"), F.lit("-")), title, file_slug(title)))
    asked = books.select("book_id", F.explode(F.filter(names, lambda n: n != "")).alias("name"))
    stored = books.join(known.select("path"), F.col("stored_path") == F.col("path"), "left_semi").select("book_id", F.lit(0).alias("by"), F.col("stored_path").alias("path"))
    named = asked.join(known.select("name", "path"), "name").select("book_id", F.lit(1).alias("by"), "path")
    slugged = asked.select("book_id", file_slug(F.col("name")).alias("slug")).distinct().join(known.where("slug <> ''").select("slug", "path"), "slug").select("book_id", F.lit(2).alias("by"), "path")
    best = stored.unionByName(named).unionByName(slugged).groupBy("book_id").agg(F.min(F.struct("by", "path")).alias("_b"))
    return best.select("book_id", "_b.path")


def signature(files: DataFrame, folder: str = "folder") -> DataFrame:
    """(folder, signature) of files (folder, length, modified): their number, bytes and newest second, by which a changed folder is told."""
    rows = files.groupBy(folder).agg(F.count("*").alias("n"), F.sum("length").alias("b"), F.max(F.unix_timestamp("modified")).alias("m"))
    return rows.select(folder, F.concat_ws("-", "n", "b", "m").alias("signature"))


def book_id_of(value: Column) -> Column:
    """The id in a value that is one, or a JSON object that holds one under book_id, id, title, book_title or $oid, at whatever depth up to three; empty for null."""
    out = value
    for _ in range(3):
        inner = F.coalesce(*(F.nullif(F.get_json_object(out, path), F.lit("")) for path in ("$.book_id", "$.id", "$.title", "$.book_title", "$['$oid']")))
        out = F.when(F.startswith(F.ltrim(out), F.lit("{")), F.coalesce(inner, F.lit(""))).otherwise(out)
    return F.trim(F.coalesce(out, F.lit("")))


def cited_books(citations: DataFrame, library: DataFrame) -> DataFrame:
    """(citation_id, book_id): the book of each cited title, by the display name in any letter case, else the title itself."""
    named = library.groupBy(F.lower("title").alias("_key")).agg(F.min("book_id").alias("_book"))
    rows = citations.withColumn("_key", F.lower("title")).join(named, "_key", "left")
    return rows.select("citation_id", F.coalesce("_book", "title").alias("book_id"))


def without_citations(text: Column) -> Column:
    """An answer without bracketed citations and without folded thoughts."""
    bare = F.regexp_replace(F.regexp_replace(text, r"(?s)<think>.*?</think>", ""), r"\s*\[Book:[^\]]*\]", "")
    return F.trim(bare)


def highlighted(item: Column, excerpt: Column, words: int = 15) -> Column:
    """Whether a text item holds one of the first words of an excerpt that are longer than four characters."""
    taken = F.slice(F.filter(F.split(F.lower(excerpt), r"\s+"), lambda w: F.length(w) > 4), 1, words)
    return F.coalesce(F.exists(taken, lambda w: F.contains(F.lower(item), w)), F.lit(False))
