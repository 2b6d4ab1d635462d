"""Ratios that are a half in their last shown decimal, and turns that begin and end together, against DuckDB."""

import duckdb
import pytest
from colloquy.operators import language as lg
from colloquy.plans import registry

from test_oracles import rows

#: Totals of which odd parts are a half in the tenth decimal of the ratio, or in the third one of its percentage.
TOTALS = (5_120, 25_600, 128_000, 160, 800, 4_000, 20_000)


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    """A speaker alone in each meeting, with two languages of known lengths; and a meeting of turns that come three times."""
    path = str(tmp_path_factory.mktemp("halves"))
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    con.execute(f"""COPY (SELECT * FROM (
      SELECT k * 6 + i * 4 AS event_id, TIMESTAMP '2024-01-01 00:00:00' + to_hours(8 * i) AS ts, 15 * k AS user_id, 'view' AS event_type,
        (CASE i WHEN 0 THEN part ELSE total - part END) / 2000 AS value, NULL::VARCHAR AS props
      FROM (SELECT k, {list(TOTALS)}[k % {len(TOTALS)} + 1] AS total, (2 * (k * 7919 % 50021) + 1) % total AS part FROM range(700) r(k)), range(2) s(i)
      UNION ALL SELECT 10000 + k, TIMESTAMP '2024-01-02 00:00:00' + to_milliseconds(k // 3 * 64000), 15 * (k // 3 % 40) + k // 120 % 2, 'view', 1 + k // 3 % 5, NULL FROM range(30000) r(k))
      ORDER BY hash(event_id)) TO '{path}/events.parquet'""")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{path}/events.parquet'")
    return path, con


@pytest.mark.parametrize("name", ["K1_speakers_csv", "V5_speaker_stats", "V10_meeting_stats", "V11_conversation_analytics", "V11_speaker_languages", "I4_speaker_intervals", "I8_gap_merge"])
def test_halves_and_equal_turns(spark, tables, name):
    path, con = tables
    frame, wanted = registry.queries()[name](spark, path), con.sql(registry.oracle_sql()[name])
    assert rows(frame.columns, [tuple(r) for r in frame.collect()]) == rows(wanted.columns, wanted.fetchall())


def test_percentages_are_half_even_on_the_ratio(spark, tables):
    from colloquy.sources.sinks import _percent
    from pyspark.sql import functions as F

    # 0.625, 6.875, 33.125, 14.375 and 0.14375 per cent
    parts = spark.createDataFrame([(1, 160), (11, 160), (53, 160), (2_875, 20_000), (23, 16_000)], "a long, b long")
    assert [r[0] for r in parts.select(_percent(F.col("a") / F.col("b"))).collect()] == [0.62, 6.88, 33.12, 14.38, 0.14]


def test_switches_between_regions_of_equal_times(spark):
    spans = spark.createDataFrame([(1, 0, 10, x, "A") for x in ("hi", "en", "hi", "en", "hi", "en")], "meeting_id long, start_ms long, end_ms long, language string, speaker string")
    assert lg.switch_points(spans.repartition(3)).count() == 1
