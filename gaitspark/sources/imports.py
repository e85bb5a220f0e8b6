"""Published data sets as sources: MATLAB trials and spreadsheet speed series.

MATLAB files need scipy, which is optional: without it the format is registered and
says so when it is used. Spreadsheets are read from their XML.
"""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.labels import shamble_label

# Sheets of the gait workbook with their label and species; frame rates of both sets.
SHEETS = {
    "Siler collingwoodi_normal": ("siler", "Siler collingwoodi"),
    "Siler collingwoodi_blackened": ("siler", "Siler collingwoodi (blackened control)"),
    "Phintelloides versicolor": ("other_spider", "Phintelloides versicolor"),
    "Crematogaster egidyi": ("ant", "Crematogaster egidyi"),
    "Meranoplus bicolor": ("ant", "Meranoplus bicolor"),
    "Technomyrmex sp.": ("ant", "Technomyrmex sp."),
    "Polyrhachis jianghuaensis": ("ant", "Polyrhachis jianghuaensis"),
    "Polyrhachis dives": ("ant", "Polyrhachis dives"),
}
GAIT_FPS, ARENA_FPS = 100.0, 120.0

ARENA = "episode_id string, species string, file_name string, date string, time string, first_frame long, last_frame long, frame long, x double, y double"


def _whole(field) -> int | None:
    """The integer of a field; none if it is empty or no number."""
    try:
        return int(field)
    except (TypeError, ValueError):
        return None


def trial_rows(trial, name: str) -> Iterator[tuple]:
    """Samples of one trial of the arena data: positions in cm, species, file, date and the range of source frames.

    trial has the data set's own fields: Rcm_mm, species_name, file_name, date, time,
    data_first_frame, data_last_frame; a frame that is not given is null, see arena_samples(). A trial
    without positions gives no rows.
    """
    places = getattr(trial, "Rcm_mm", None)
    if places is None or not hasattr(places, "__len__"):
        return
    if len(places) and not hasattr(places[0], "__len__"):
        places = [places]
    text = lambda field: str(getattr(trial, field, "")).strip()
    first, last = (_whole(getattr(trial, field, None)) for field in ("data_first_frame", "data_last_frame"))
    for i, p in enumerate(places):
        if len(p) >= 2:
            yield (name, text("species_name"), text("file_name"), text("date"), text("time"), first, last, i, float(p[0]), float(p[1]))


class ShambleReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in self.path.split(",")]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        try:
            from scipy.io import loadmat
        except ImportError as e:
            raise RuntimeError("reading .mat files needs scipy") from e
        trials = loadmat(partition.value, squeeze_me=True, struct_as_record=False)["data"]
        for i, t in enumerate(trials):
            yield from trial_rows(t, f"{partition.value}#{i}")


class ShambleSource(DataSource):
    """S3: samples of trials, one partition per file."""

    @classmethod
    def name(cls) -> str:
        return "shamble"

    def schema(self) -> str:
        return ARENA

    def reader(self, schema) -> DataSourceReader:
        return ShambleReader(self.options["path"])


def _column(reference: str) -> int:
    """0 for A, 25 for Z, 26 for AA."""
    n = 0
    for c in re.match("[A-Z]+", reference)[0]:
        n = 26 * n + ord(c) - 64
    return n - 1


def sheet_rows(path: str) -> Iterator[tuple[str, int, dict[int, str]]]:
    """(sheet, row number from 1, cells by column) of a workbook; text and numbers as text, empty cells left out."""
    plain = lambda tag: tag.rpartition("}")[2]
    text_of = lambda node: "".join(t.text or "" for t in node.iter() if plain(t.tag) == "t")
    with zipfile.ZipFile(path) as book:
        shared = []
        if "xl/sharedStrings.xml" in book.namelist():
            shared = [text_of(x) for x in ElementTree.fromstring(book.read("xl/sharedStrings.xml")) if plain(x.tag) == "si"]
        links = {x.get("Id"): x.get("Target") for x in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
        sheets = [x for x in ElementTree.fromstring(book.read("xl/workbook.xml")).iter() if plain(x.tag) == "sheet"]
        for sheet in sheets:
            target = links[next(v for k, v in sheet.attrib.items() if plain(k) == "id")]
            part = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
            with book.open(part) as f:
                at = 0
                for _, row in ElementTree.iterparse(f):
                    if plain(row.tag) != "row":
                        continue
                    at, cells = int(row.get("r", at + 1)), {}
                    for i, c in enumerate(row):
                        kind, value = c.get("t"), next((x.text for x in c if plain(x.tag) == "v"), None)
                        text = text_of(c) if kind == "inlineStr" else shared[int(value)] if kind == "s" and value is not None else value
                        if text is not None and kind not in ("b", "e"):
                            cells[_column(c.get("r")) if c.get("r") else i] = ("" if kind in (None, "n") else "'") + text
                    yield sheet.get("name"), at, cells
                    row.clear()


def _number(cell: str | None) -> float | None:
    """A numeric cell; text, even of digits, is none."""
    return None if cell is None or cell.startswith("'") else float(cell)


class ZengReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in self.path.split(",")]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for sheet, at, cells in sheet_rows(partition.value):
            name = cells.get(0)
            if sheet in SHEETS and at > 1 and name is not None:
                yield (sheet, name.removeprefix("'").strip(), at, *(_number(cells.get(i)) for i in (1, 2, 3)))


class ZengSource(DataSource):
    """Rows of the eight known sheets: individual, row number, speed and both limb heights; rows without individual are skipped."""

    @classmethod
    def name(cls) -> str:
        return "zeng"

    def schema(self) -> str:
        return "sheet string, individual string, row long, v double, limb1 double, limb2 double"

    def reader(self, schema) -> DataSourceReader:
        return ZengReader(self.options["path"])


def register_sources(spark: SparkSession) -> None:
    spark.dataSource.register(ShambleSource)
    spark.dataSource.register(ZengSource)


def arena_samples(samples: DataFrame, least: int = 360) -> DataFrame:
    """S3: samples with label, session and frame rate; trials without a label or with fewer finite positions than a third of ``least`` are left out.

    Where a trial's first or last source frame is missing, or the last isn't after the first, its range is that of its sample numbers.
    """
    by = W.partitionBy("episode_id")
    ok = F.col("x").isNotNull() & ~F.isnan("x") & F.col("y").isNotNull() & ~F.isnan("y")
    rows = samples.withColumns({"label": shamble_label(F.col("species")), "_good": F.count_if(ok).over(by)})
    stated = F.coalesce(F.col("last_frame") > F.col("first_frame"), F.lit(False))
    end = F.max("frame").over(by)
    rows = rows.withColumns({"first_frame": F.when(stated, F.col("first_frame")).otherwise(0).cast("long"), "last_frame": F.when(stated, F.col("last_frame")).otherwise(end)})
    rows = rows.where(F.col("label").isNotNull() & (F.col("_good") >= least // 3)).drop("_good")
    day = F.coalesce(F.nullif("date", F.lit("")), F.lit("unknown_date"))
    return rows.withColumns({"site_id": F.lit("shamble2017_dryad"), "session_id": F.concat(F.lit("shamble2017_dryad/"), day), "source_video_id": F.col("file_name"), "fps": F.lit(ARENA_FPS)})


def with_videos(samples: DataFrame, videos: DataFrame) -> DataFrame:
    """S3: adds video_path, the first of videos (path) whose name begins with the trial's file name without its ending, in any case; null where none does.

    videos is a listing of a few thousand files at most, which is broadcast.
    """
    stem = lambda c: F.upper(F.regexp_replace(F.regexp_extract(c, r"([^/\\]*)$", 1), r"\.[^.]*$", ""))
    names = samples.select("file_name").distinct().withColumn("_stem", stem(F.col("file_name"))).where("_stem <> ''")
    listed = F.broadcast(videos.select("path", stem(F.col("path")).alias("_video")))
    found = names.join(listed, F.col("_video").startswith(F.col("_stem"))).groupBy("file_name").agg(F.min("path").alias("video_path"))
    return samples.join(found, "file_name", "left")


def gait_rows(rows: DataFrame, least: int = 150) -> DataFrame:
    """Velocity episodes (episode_id, i, v, limb1, limb2, label, species, site_id, session_id, fps); individuals with fewer rows than least are left out."""
    by = W.partitionBy("sheet", "individual")
    rows = rows.withColumns({"i": F.row_number().over(by.orderBy("row")) - 1, "_n": F.count("*").over(by)}).where(F.col("_n") >= least)
    known = F.create_map(*[F.lit(x) for name, (label, _) in SHEETS.items() for x in (name, label)])
    species = F.create_map(*[F.lit(x) for name, (_, kind) in SHEETS.items() for x in (name, kind)])
    return rows.select(
        F.concat_ws("/", "sheet", "individual").alias("episode_id"), F.col("i").cast("long").alias("i"), "v", "limb1", "limb2", F.try_element_at(known, F.col("sheet")).alias("label"), F.try_element_at(species, F.col("sheet")).alias("species"),
        F.lit("zeng2023_gait").alias("site_id"), F.concat(F.lit("zeng2023_gait/"), F.col("sheet")).alias("session_id"), F.lit(GAIT_FPS).alias("fps"),
    )
