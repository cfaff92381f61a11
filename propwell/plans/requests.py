"""The requests a user makes, over tables kept under one root folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from propwell import fixed, schema
from propwell.functions.geometry import BBox
from propwell.operators import catalog, ingest, jobs, layers, records, sinks
from propwell.operators.hash_index import HashIndex
from propwell.operators.state_log import StateLog
from propwell.sources import store
from propwell.sources.items import read_landed_pages, whole_sequences
from propwell.sources.registry import Source, get_source, implemented_sources
from propwell.streaming.incremental import incremental_ingest


class JobAlreadyRunning(RuntimeError):
    """The source has a running job."""


def _now() -> datetime:
    return datetime.now(timezone.utc)


def _new_id() -> str:
    return uuid.uuid4().hex[:24]


def _counters(seen: int, inserted: int) -> dict[str, int]:
    return {"records_inserted": inserted, "records_skipped": seen - inserted}


@dataclass(frozen=True)
class MarketStore:
    """Paths of the stored tables and the requests over them.

    Records are a folder under `root`, or, with `records_table`, a catalog table bucketed by
    hash. The latter lets ingest compare a batch with a large store without moving the store. With
    `indexed`, ingest reads only those stored hashes that a sketch of them cannot rule out.
    """

    spark: SparkSession
    root: str
    records_table: str | None = None
    buckets: int = 1024
    indexed: bool = False

    def path(self, table: str) -> str:
        return f"{self.root.rstrip('/')}/{table}"

    def create(self) -> None:
        """Empty tables and the seeded registry; existing tables are left alone."""
        make = self.spark.createDataFrame
        for table, columns in (
            ("pipeline_logs", schema.LOGS),
            ("layer_configs", schema.LAYERS),
        ):
            make([], columns).write.mode("ignore").parquet(self.path(table))
        records_writer = make([], schema.RAW_RECORDS).write.mode("ignore").partitionBy("source_name")
        if self.records_table is None:
            records_writer.parquet(self.path("raw_records"))
        else:
            bucketed = records_writer.bucketBy(self.buckets, "content_hash").sortBy("content_hash")
            bucketed.saveAsTable(self.records_table)
        seeds = catalog.seed_sources(self.spark)
        self.registry.update(lambda now: catalog.upsert_sources(now.join(seeds, "name", "left_semi"), seeds))

    # tables

    @property
    def job_states(self) -> StateLog:
        return StateLog(self.spark, self.path("scrape_jobs"), schema.JOBS, "job_id")

    @property
    def registry(self) -> StateLog:
        return StateLog(self.spark, self.path("source_registry"), schema.SOURCES, "name")

    def records(self, **predicates: object) -> DataFrame:
        if self.records_table is not None:
            return records.filter_records(self.spark.table(self.records_table), **predicates)
        return store.scan_raw_records(self.spark, self.path("raw_records"), **predicates)

    def jobs(self, status: str | None = None) -> DataFrame:
        return jobs.filter_jobs_by_status(self.job_states.read(), status)

    def sources(self) -> DataFrame:
        return self.registry.read().orderBy("name")

    def layers(self) -> DataFrame:
        configs = self.spark.read.schema(schema.LAYERS).parquet(self.path("layer_configs"))
        return layers.scan_layers(configs, layers.default_layers(self.spark))

    # ingest

    def recover(self, now: datetime | None = None) -> int:
        """Fail jobs a crash left open; returns how many."""
        ended, changed = now or _now(), 0

        def fail_open(current: DataFrame) -> DataFrame:
            nonlocal changed
            changed = jobs.count_stale_jobs(current).head().recovered
            return jobs.recover_stale_jobs(jobs.open_jobs(current), ended)

        if jobs.count_stale_jobs(self.jobs()).head().recovered:
            self.job_states.update(fail_open)
        return changed

    def _transition(self, job_id: str, status: str, **values: object) -> None:
        fields = {f.name: f.dataType for f in self.jobs().schema.fields if f.name in values}
        change = self.spark.range(1).select(
            F.lit(job_id).alias("job_id"),
            F.lit(status).alias("status"),
            F.lit(0).alias("seq"),
            F.array(*[F.lit(name) for name in fields]).cast("array<string>").alias("set_fields"),
            *[
                (F.array(*[F.lit(v) for v in values[name]]) if isinstance(values[name], list)
                 else F.lit(values[name])).cast(dtype).alias(name)
                for name, dtype in fields.items()
            ],
        )
        self.job_states.update(lambda now: jobs.transition_jobs(now.filter(F.col("job_id") == job_id), change, list(fields)))

    def _new_job(self, source_name: str) -> str:
        job_id = _new_id()
        request = self.spark.range(1).select(
            F.lit(job_id).alias("job_id"), F.lit(source_name).alias("source_name")
        )
        created = jobs.create_jobs(jobs.empty_jobs(self.spark), request, _now())
        self.job_states.update(lambda _: created)
        return job_id

    def _run(self, source_name: str, work: Callable[[str, Source], tuple[int, int]]) -> str:
        """A job around `work`, which returns how many rows came in and how many were stored.

        Failures end in the job and its log. Both counts are taken by the writes themselves.
        """
        request = self.spark.range(1).select(F.lit(source_name).alias("source_name"))
        if not jobs.has_running_job(request, self.jobs()).isEmpty():
            raise JobAlreadyRunning(source_name)
        job_id = self._new_job(source_name)
        self._transition(job_id, "running", started_at=_now())
        try:
            seen, inserted = work(job_id, self.runnable_source(source_name))
            self._transition(job_id, "completed", completed_at=_now(), **_counters(seen, inserted))
        except Exception as error:  # the job table is where a failed run is reported
            self._transition(job_id, "failed", completed_at=_now(), error_message=str(error))
            self._log_error(job_id, source_name, str(error))
        return job_id

    def _enveloped(self, items: DataFrame, job_id: str, source: Source) -> tuple[DataFrame, int]:
        """The items as records, and how many."""
        kept, seen = sinks.materialize_counted(items, "items")
        return ingest.record_envelope(
            kept,
            source_name=source.name,
            source_url=source.source_url,
            retrieval_method=source.retrieval_method,
            job_id=job_id,
            ingested_at=_now(),
        ), seen

    @property
    def hashes(self) -> HashIndex:
        return HashIndex(self.spark, self.path("hash_index"))

    def _existing(self, batch: DataFrame) -> DataFrame:
        """Stored rows, at least those whose hash `batch` has."""
        if not self.indexed:
            return self.records()
        self.hashes.refresh(self.records())
        return self.hashes.matching(batch)

    def _append(self, fresh: DataFrame) -> int:
        rows = fresh.select(*self.records().columns)
        if self.records_table is not None:
            return sinks.save_bucketed(rows, self.records_table, self.buckets)
        return sinks.append_records(rows, self.path("raw_records"))

    def collect_source(self, source_name: str, landed_path: str) -> str:
        """Ingest one source's landed data; returns the job id."""

        def work(job_id: str, source: Source) -> tuple[int, int]:
            failed = 0
            if source.scan_pages is None:
                found = source.scan(self.spark, landed_path)
            else:
                pages = read_landed_pages(self.spark, f"{landed_path}/{source.pages}".rstrip("/"))
                scanned = source.scan_pages(self.spark, landed_path, pages)
                found, failed = scanned.items, self._log_failed(job_id, source.name, scanned.failed)
                self._log_rejected(job_id, source.name, scanned.rejected)
            batch, seen = self._enveloped(found, job_id, source)
            inserted = self._append(ingest.ingest_dedup(batch, self._existing(batch)))
            return self._seen(job_id, seen, failed), inserted

        return self._run(source_name, work)

    def collect_incremental(
        self, source_name: str, landed_path: str, checkpoint: str, files_per_batch: int = 1000
    ) -> str:
        """Ingest what landed since the last call, some files at a time; returns the job id.

        Each batch takes the whole sequences (a city, a series) its files have pages of, so the
        result does not depend on how sequences lie in files or files in batches. Failed units
        are left out and logged; they stop nothing. The job's counters rise with every batch,
        and a failure keeps what was stored before it.
        """

        def work(job_id: str, source: Source) -> tuple[int, int]:
            if source.scan_pages is None:
                raise LookupError(f"source {source_name!r} does not land as pages")
            folder = f"{landed_path}/{source.pages}".rstrip("/")
            seen = inserted = failed = 0
            batch: DataFrame | None = None

            def prepare(pages: DataFrame) -> DataFrame:
                nonlocal batch, seen, failed
                whole = whole_sequences(pages, read_landed_pages(self.spark, folder))
                scanned = source.scan_pages(self.spark, landed_path, whole)
                failed += self._log_failed(job_id, source.name, scanned.failed)
                self._log_rejected(job_id, source.name, scanned.rejected)
                batch, came = self._enveloped(scanned.items, job_id, source)
                seen += came
                return batch

            def append(fresh: DataFrame) -> None:
                nonlocal inserted
                inserted += self._append(fresh)
                self._transition(job_id, "running", **_counters(seen, inserted))

            stream = (
                self.spark.readStream.schema(schema.LANDED_PAGE_OF_RUN)
                .option("maxFilesPerTrigger", files_per_batch)
                .parquet(folder)
            )
            incremental_ingest(
                stream, lambda: self._existing(batch), append, checkpoint, prepare=prepare
            ).awaitTermination()
            return self._seen(job_id, seen, failed), inserted

        return self._run(source_name, work)

    def runnable_source(self, source_name: str) -> Source:
        """The registered source, unless the registry says it must not run."""
        request = self.spark.range(1).select(F.lit(source_name).alias("source_name"))
        checked = catalog.runnable_source_check(
            request, self.sources(), implemented_sources(self.spark)
        )
        verdict = checked.head().verdict
        if verdict != "runnable":
            raise LookupError(f"source {source_name!r}: {verdict}")
        return get_source(source_name)

    def _log_failed(self, job_id: str, source_name: str, failed: DataFrame) -> int:
        """One log row per failed unit; returns how many."""
        entries = failed.select(
            F.substring(F.sha2(F.concat_ws("/", F.lit(_new_id()), "run_id", "unit"), 256), 1, 24).alias("log_id"),
            F.lit(job_id).alias("job_id"),
            F.lit("warning").alias("level"),
            F.concat(F.lit("failed: "), F.coalesce("unit", F.lit(""))).alias("message"),
            F.lit(_now()).alias("created_at"),
            F.create_map(F.lit("source_name"), F.lit(source_name), F.lit("unit"), "unit", F.lit("run_id"), "run_id").alias("details"),
        )
        kept = sinks.materialize(entries, "failed")
        sinks.append_rows(kept, self.path("pipeline_logs"))
        return kept.count()

    def _log_rejected(self, job_id: str, source_name: str, rejected: DataFrame | None) -> None:
        """One log row per page and kind of bad member; the page's other members are stored."""
        if rejected is None:
            return
        place = [F.col(c).cast("string") for c in ("run_id", "unit", "page", "error")]
        details = [F.lit("source_name"), F.lit(source_name)]
        for name in ("unit", "run_id", "page", "n"):
            details += [F.lit(name), F.col(name).cast("string")]
        entries = rejected.select(
            F.substring(F.sha2(F.concat_ws("/", F.lit(_new_id()), *place), 256), 1, 24).alias("log_id"),
            F.lit(job_id).alias("job_id"),
            F.lit("warning").alias("level"),
            F.concat(F.lit("rejected: "), F.col("error")).alias("message"),
            F.lit(_now()).alias("created_at"),
            F.create_map(*details).alias("details"),
        )
        sinks.append_rows(entries, self.path("pipeline_logs"))

    def _seen(self, job_id: str, seen: int, failed: int) -> int:
        """`seen`, unless a run brought nothing because units failed; their log has every name."""
        if failed and not seen:
            log = self.job_log(job_id).filter("level = 'warning' AND message LIKE 'failed: %'")
            names = [row.message for row in log.limit(20).collect()]
            raise RuntimeError(f"no rows, {failed} units failed (all in the log): " + "; ".join(names))
        return seen

    def _log_error(self, job_id: str, source_name: str, message: str) -> None:
        entry = self.spark.range(1).select(
            F.lit(_new_id()).alias("log_id"),
            F.lit(job_id).alias("job_id"),
            F.lit("error").alias("level"),
            F.lit(message).alias("message"),
            F.lit(_now()).alias("created_at"),
            F.create_map(F.lit("source_name"), F.lit(source_name)).alias("details"),
        )
        sinks.append_rows(entry, self.path("pipeline_logs"))

    def collect_all(self, landed_paths: dict[str, str]) -> str:
        """Ingest every active source that landed; returns the parent job id."""
        parent = self._new_job(fixed.ALL_SOURCES_JOB)
        self._transition(parent, "running", started_at=_now())
        children = []
        for name in [seed[0] for seed in fixed.SEED_SOURCES if seed[3] == "active"]:
            if name in landed_paths:
                try:
                    children.append(self.collect_source(name, landed_paths[name]))
                except JobAlreadyRunning:
                    continue
        self._transition(parent, "running", sub_job_ids=children)
        table = self.jobs()
        parents = table.filter(F.col("job_id") == parent)
        family = jobs.parent_children(jobs.child_links(parents), table)
        status = jobs.rollup_parent_status(parents, family).head().rolled_status
        self._transition(parent, status, completed_at=_now())
        return parent

    # tabular reads

    def list_records(
        self, limit: int = fixed.DEFAULT_PAGE_LIMIT, offset: int = 0, **predicates: object
    ) -> DataFrame:
        """A page of records, newest first, with the total in `total`."""
        return records.page_records_with_total(
            self.records(**predicates), limit=limit, offset=offset
        )

    def count(self, **predicates: object) -> DataFrame:
        return records.count_records(self.records(**predicates))

    def get_record(self, record_id: str) -> DataFrame:
        return records.lookup_by_id(self.records(), record_id)

    def get_job(self, job_id: str) -> DataFrame:
        return records.lookup_by_id(self.jobs(), job_id, "job_id")

    def job_log(self, job_id: str, limit: int | None = None, offset: int = 0) -> DataFrame:
        logs = store.scan_logs(self.spark, self.path("pipeline_logs"), job_id)
        return jobs.page_logs(logs, job_id, limit, offset)

    def list_jobs(self, status: str | None = None, limit: int = 20, offset: int = 0) -> DataFrame:
        return jobs.page_jobs(self.jobs(), status, limit, offset)

    def list_all_jobs(self, limit: int | None = None) -> DataFrame:
        return jobs.all_jobs(self.jobs(), limit)

    def list_sources(self, limit: int = 20, offset: int = 0) -> DataFrame:
        return catalog.page_sources(self.sources(), limit, offset)

    def collections_status(self, limit: int = 20, offset: int = 0) -> DataFrame:
        return catalog.page_status(catalog.source_status(self.sources(), self.jobs()), limit, offset)

    def price_history(self, source_name: str, listing_id: str) -> DataFrame:
        """Stored versions of one listing with the price before."""
        versions = records.lookup_listing(self.records(), source_name, listing_id)
        priced = versions.withColumn("price", F.try_variant_get("raw_payload", "$.price", "bigint"))
        return records.listing_price_history(
            priced, ["source_name", "listing_id"], "ingested_at", "record_id", "price"
        )

    # spatial read

    def map_features(
        self, layer_id: str, box: BBox, key: Sequence[str] = (), most: int | None = None
    ) -> DataFrame:
        """Valid features of a configured layer inside a box, at most `most` where given.

        They are ordered by `key`, then place, then geometry, so that a cut result is the same
        each time. The box is compared with columns written with the layer where there are
        any, so that a scan skips files and row groups.
        """
        valid, _ = layers.split_valid(self._in_box(layer_id, box))
        edges = [c for c in layers.EDGES if c in valid.columns]
        place = edges or ["lng", "lat"]
        picked = layers.bbox_limit(valid, [*key, *place, F.to_json("geometry")], most)
        return layers.feature_projection(picked.drop(*edges))

    def map_rejects(self, layer_id: str, box: BBox) -> DataFrame:
        """Rows of a layer inside a box whose geometry is not valid."""
        return layers.split_valid(self._in_box(layer_id, box))[1]

    def _in_box(self, layer_id: str, box: BBox) -> DataFrame:
        rows = layers.drop_internal_id(
            store.scan_layer_features(self.spark, self.layers(), layer_id, self.root)
        )
        if set(layers.EDGES) <= set(rows.columns):
            return layers.bbox_filter_bounds(rows, box)
        if {"lng", "lat"} <= set(rows.columns):
            return layers.bbox_filter(rows, box)
        return layers.bbox_filter_bounds(layers.with_bounds(rows), box)
