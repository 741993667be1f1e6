"""A chain of steps over jobs that can be broken off anywhere and started again.

Below a root folder of the shared store:

    data/STEP/chain_execution=ID    rows that one execution of a step made, written before its log
    log/STEP/chain_execution=ID     a stage result per job of that execution, never changed
    runs/RUN/...                    what one run worked out on the way: keys of the inputs, jobs to do, jobs done
    finished/RUN.json               written last, by one rename: the run's steps, in order

A job's key at a step is a digest of its input rows, of the names and settings of all steps so far. Before a step, jobs
whose key is in its log as done are taken out; their rows are read from the execution that made them. So a run that was
broken off repeats no finished job, a changed setting repeats its step and those behind it, a changed input its job.
A job fails at a step when one of its rows there has an error; its rows don't go on, and later runs try it again, `attempts`
times in all. If two runs make the same job at once, the smaller execution counts.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from datetime import UTC, datetime

from pyarrow.fs import FileSelector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.transcripts import assemble, job_languages, synthesis_requests, translate
from ..operators.validation import stage_result
from ..sources.stores import replace, store_of
from .backends import InferenceBackend, Synthesiser, TranslationBackend, Translator, recognise, settings, synthesise
from .stages import Config, Preprocess

EXECUTION = "chain_execution"
PIECES, PIECE = 4, 15


@dataclass(frozen=True)
class Step:
    """run turns the rows of jobs (job_id and more) into rows of the same jobs; a column `error` that isn't null fails the
    row's job. settings: all that changes what run makes."""

    name: str
    run: Callable[[DataFrame], DataFrame]
    settings: str = ""


@dataclass(frozen=True)
class Run:
    """A finished run: its id, the root, the names of its steps."""

    root: str
    id: str
    steps: tuple[str, ...]


def new_id() -> str:
    """Later ids are greater; a letter in front keeps them strings as partition values."""
    return f"x{datetime.now(UTC):%Y%m%d%H%M%S%f}{uuid.uuid4().hex[:8]}"


def fingerprints(jobs: DataFrame) -> DataFrame:
    """job_id and key of each job: a digest of its rows, whatever their order and that of their columns; repeated rows
    count. Rows without a job_id have no job. Digests of rows are added up in pieces, so no job's rows are gathered."""
    kinds = dict(jobs.dtypes)
    told = [(F.sha2(c, 256) if kinds[c] == "binary" else F.col(c)).alias(c) for c in sorted(jobs.columns)]
    rows = jobs.where(F.col("job_id").isNotNull()).select("job_id", F.sha2(F.to_json(F.struct(*told)), 256).alias("h"))
    piece = lambda k: F.conv(F.substring("h", k * PIECE + 1, PIECE), 16, 10).cast("decimal(38,0)")
    sums = rows.groupBy("job_id").agg(F.count(F.lit(1)).alias("n"), *(F.sum(piece(k)).alias(f"s{k}") for k in range(PIECES)))
    return sums.select("job_id", F.sha2(F.concat_ws(":", "n", *(f"s{k}" for k in range(PIECES))), 256).alias("key"))


def key_after(step: Step) -> Column:
    return F.sha2(F.concat_ws("\n", "key", F.lit(step.name), F.lit(step.settings)), 256)


def stored(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def step_log(spark: SparkSession, root: str, step: str, job_type: str = "string") -> DataFrame:
    """All stage results of a step, with the jobs' keys and the executions; empty if it never ran."""
    kinds = f"job_id {job_type}, key string, stage_name string, status string, output_path string, metrics map<string,double>, error string, attempt int, {EXECUTION} string"
    path = f"{root}/log/{step}"
    store, at = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(store).exists(at):
        return spark.createDataFrame([], kinds)
    return spark.read.schema(kinds).parquet(path)


def executed(step: Step, rows: DataFrame, todo: DataFrame, root: str) -> None:
    """One execution of a step: its rows, then its log."""
    execution = new_id()
    path = f"{root}/data/{step.name}/{EXECUTION}={execution}"
    made = step.run(rows.join(todo.select("job_id"), "job_id", "left_semi"))
    if EXECUTION in made.columns:
        raise ValueError(f"{step.name}: the column {EXECUTION} is the chain's own")
    made = stored(made, path)
    error = F.col("error").cast("string") if "error" in made.columns else F.lit(None).cast("string")
    totals = made.groupBy("job_id").agg(F.count(F.lit(1)).alias("n"), F.min(error).alias("why"))
    ended = todo.join(totals, "job_id", "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("double"))
    metrics, attempt = F.create_map(F.lit("num_rows"), F.col("n")), F.col("failures") + 1
    done = F.col("why").isNull()
    result = stage_result(step.name, F.when(done, "done").otherwise("failed"), output=F.when(done, path), metrics=metrics, error=F.col("why"), attempt=attempt)
    log = ended.select("job_id", "key", *result)
    log.write.parquet(f"{root}/log/{step.name}/{EXECUTION}={execution}")


def run_chain(jobs: DataFrame, steps: list[Step], root: str, attempts: int = 3) -> Run:
    """Runs the steps that aren't done yet, each on the jobs that the one before it finished."""
    spark, run = jobs.sparkSession, new_id()
    if len({s.name for s in steps}) < len(steps):
        raise ValueError("steps need names of their own")
    known, rows, kind = stored(fingerprints(jobs), f"{root}/runs/{run}/inputs"), jobs, dict(jobs.dtypes)["job_id"]
    for step in steps:
        own = f"{root}/runs/{run}/{step.name}"
        keys = known.select("job_id", key_after(step).alias("key"))
        past = step_log(spark, root, step.name, kind)
        tried = past.groupBy("job_id", "key").agg(F.count_if(F.col("status") == "done").alias("successes"), F.count_if(F.col("status") == "failed").cast("int").alias("failures"))
        state = keys.join(tried, ["job_id", "key"], "left").fillna(0, ["successes", "failures"])
        todo = stored(state.where((F.col("successes") == 0) & (F.col("failures") < attempts)).select("job_id", "key", "failures"), f"{own}/todo")
        if not todo.isEmpty() or past.isEmpty():
            executed(step, rows, todo, root)
        past = step_log(spark, root, step.name, kind).join(keys, ["job_id", "key"], "left_semi")
        result, finished = F.struct("stage_name", "status", "output_path", "metrics", "error", "attempt", EXECUTION), F.col("status") == "done"
        counts = past.groupBy("job_id", "key").agg(F.coalesce(F.min_by(result, F.when(finished, F.col(EXECUTION))), F.max_by(result, F.struct("attempt", EXECUTION))).alias("r"))
        ended = stored(counts.select("job_id", "key", "r.*"), f"{own}/ended")
        known = ended.where("status = 'done'").select("job_id", "key")
        rows = rows_of(spark, root, step.name, ended)
    pointer = {"run": run, "steps": [s.name for s in steps]}
    store, top = store_of(root)
    store.create_dir(f"{top}/finished", recursive=True)
    with store.open_output_stream(f"{top}/runs/{run}/pointer.json") as out:
        out.write(json.dumps(pointer).encode())
    replace(store, f"{top}/runs/{run}/pointer.json", f"{top}/finished/{run}.json")
    return Run(root, run, tuple(pointer["steps"]))


def rows_of(spark: SparkSession, root: str, step: str, ended: DataFrame) -> DataFrame:
    """Rows of the finished jobs, read from the executions that made them (their names are collected: a few a run)."""
    ids = [r[0] for r in ended.select(EXECUTION).distinct().collect()]
    base = f"{root}/data/{step}"
    read = spark.read.option("basePath", base).option("mergeSchema", "false")
    made = read.parquet(*(f"{base}/{EXECUTION}={i}" for i in ids)) if ids else read.parquet(base).where("false")
    done = ended.where("status = 'done'").select("job_id", F.col(EXECUTION))
    return made.withColumn(EXECUTION, F.col(EXECUTION).cast("string")).join(done, ["job_id", EXECUTION], "left_semi").drop(EXECUTION)


def last_run(spark: SparkSession, root: str) -> Run | None:
    """The last run that finished, if there is one."""
    store, top = store_of(root)
    names = [i.path for i in store.get_file_info(FileSelector(f"{top}/finished", allow_not_found=True)) if i.path.endswith(".json")]
    if not names:
        return None
    with store.open_input_stream(max(names)) as f:
        found = json.loads(f.read())
    return Run(root, found["run"], tuple(found["steps"]))


def chain_results(spark: SparkSession, run: Run) -> DataFrame:
    """Stage results of a finished run: the one that counts, for each job and step it came to."""
    out = [spark.read.parquet(f"{run.root}/runs/{run.id}/{s}/ended").drop("key", EXECUTION) for s in run.steps]
    first, *others = out
    for o in others:
        first = first.unionByName(o)
    return first


def chain_rows(spark: SparkSession, run: Run, step: str) -> DataFrame:
    """What a step of a finished run made."""
    return rows_of(spark, run.root, step, spark.read.parquet(f"{run.root}/runs/{run.id}/{step}/ended"))


def speech_steps(config: Config, recogniser: InferenceBackend, translator: Translator, synthesiser: Synthesiser, target: str, voices: DataFrame, voices_version: str = "") -> list[Step]:
    """From media to speech: jobs (job_id, size, content) are cut into chunks, recognised, translated and synthesised.
    voices: job_id, content of the voice sample; voices_version changes with them."""

    def preprocess(jobs: DataFrame) -> DataFrame:
        chunks, results = Preprocess().run(jobs, config)
        return chunks.unionByName(results.where("status = 'failed'").select("job_id", "error"), allowMissingColumns=True)

    def translation(heard: DataFrame) -> DataFrame:
        return translate(assemble(heard), job_languages(heard), target, TranslationBackend(translator))

    def synthesis(translated: DataFrame) -> DataFrame:
        requests = synthesis_requests(translated, "reference.wav", synthesis_rate(synthesiser))
        mute = requests.join(voices, "job_id", "left_anti").select("job_id", F.concat(F.lit("Reference audio missing: "), "job_id").alias("error"))
        return synthesise(requests, voices, synthesiser).unionByName(mute, allowMissingColumns=True)

    return [
        Step("preprocess", preprocess, f"{config.audio_sample_rate} {config.audio_channels}"),
        Step("asr", lambda chunks: recognise(chunks, recogniser), settings(recogniser)),
        Step("translation", translation, f"{target} {settings(translator)}"),
        Step("tts", synthesis, f"{synthesis_rate(synthesiser)} {voices_version} {settings(synthesiser)}"),
    ]


def synthesis_rate(synthesiser: Synthesiser) -> int:
    return getattr(synthesiser, "rate", 24000)
