"""Raw upstream payloads: files, or HTTP with retries."""

from __future__ import annotations

import time
import urllib.request
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .geojson import read_features

TRIES, BACK_OFF, TIMEOUT, PACE = 3, 2.0, 30, 0.3


def fetch_text(url: str, tries: int = TRIES, opener: Callable = urllib.request.urlopen, sleep: Callable = time.sleep) -> str:
    """The body of ``url``; failed tries are repeated after a pause, the last error is raised."""
    for attempt in range(tries):
        try:
            with opener(url, timeout=TIMEOUT) as response:
                return response.read().decode("utf-8")
        except OSError:
            if attempt + 1 == tries:
                raise
            sleep(BACK_OFF)
    raise ValueError("tries must be positive")


def fetch_payloads(spark: SparkSession, base: str, codes: list[str], opener: Callable = urllib.request.urlopen, sleep: Callable = time.sleep) -> DataFrame:
    """(parent, body) of the payloads ``{base}/{code}_full.json``, fetched one by one at a polite pace."""
    rows = []
    for code in codes:
        rows.append((code, fetch_text(f"{base}/{code}_full.json", opener=opener, sleep=sleep)))
        sleep(PACE)
    return spark.createDataFrame(rows, "parent string, body string")


def read_payload(spark: SparkSession, path: str) -> DataFrame:
    """Features of one or more payload files."""
    return read_features(spark, path)


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """(parent, body) of payload files, whose names begin with the parent's code."""
    text = spark.read.option("wholetext", True).text(path)
    return text.select(F.regexp_extract(F.col("_metadata.file_name"), "^([0-9]{6})", 1).alias("parent"), F.col("value").alias("body"))
