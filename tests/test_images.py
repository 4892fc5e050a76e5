"""Image queries against the same SQL in DuckDB, over the smallest tables; and errors."""

import os

import duckdb
import pytest

from pixelweave import queries
from pixelweave.functions import messages
from pixelweave.operators import analyze, geometry, neighbor, point
from pixelweave.plans.chain import FilterChain
from pixelweave.sources import derived

TABLES = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(TABLES), reason="needs the test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(TABLES):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{TABLES}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_equals_sql(spark, duck, name):
    got = queries.QUERIES[name](spark, TABLES)
    columns = sorted(got.columns)
    rows = sorted(map(tuple, got.select(columns).collect()), key=repr)
    expected = sorted(duck.sql(f"SELECT {', '.join(columns)} FROM ({queries.SQL[name]})").fetchall(), key=repr)
    assert rows == expected and rows


def test_solid_image_analysis(spark):
    image = derived.solid(spark, 64, 48, (200, 60, 40, 255))
    assert analyze.palette(image, 3).count() == 1
    assert tuple(analyze.dominant_color(image).first())[1:] == (200, 60, 40, 255)
    assert tuple(analyze.average_color(image).first())[1:] == (200, 60, 40, 255)
    assert analyze.average_color(derived.solid(spark, 2, 2, (9, 9, 9, 0))).count() == 0
    assert tuple(derived.dims(image).first()) == (0, 64, 48)


def test_sizes_and_errors(spark):
    assert neighbor.thumbnail_size(64, 48, 32) == (32, 24) and neighbor.thumbnail_size(10, 10, 32) == (10, 10)
    assert geometry.aspect_box(64, 48, 1, 1) == (8, 0, 48, 48)
    image = derived.fixed_dims(derived.solid(spark, 64, 48, (1, 2, 3, 255)), 64, 48)
    assert neighbor.thumbnail(image, 32).count() == 32 * 24
    with pytest.raises(Exception, match="outside"):
        geometry.crop(image, 60, 40, 16, 16).count()
    for bad in (lambda: geometry.crop(image, 0, 0, 0, 1), lambda: geometry.rotate_90(image, 45), lambda: neighbor.thumbnail_size(1, 1, 0), lambda: derived.solid(spark, 0, 1, (0, 0, 0, 0)), lambda: point.convert_colorspace(image, "x")):
        with pytest.raises(ValueError):
            bad()


def test_chain_json(spark):
    chain = FilterChain().push("Grayscale").push("Brightness", 10).push("Sharpen", 1.0, 3)
    again = FilterChain.from_json(chain.to_json())
    assert again.steps == chain.steps and len(again) == 3 and not again.is_empty()
    image = derived.solid(spark, 4, 4, (10, 20, 30, 7))
    assert FilterChain().push("Grayscale").apply(image).select("a").distinct().first().a == 255
    with pytest.raises(ValueError):
        chain.push("Nothing")


def test_messages():
    assert messages.active_lang({"LANG": "de_DE.UTF-8"}) == "de" and messages.active_lang({"LANG": "fr", "LC_ALL": "de"}) == "de" and messages.active_lang({}) == "en"
    assert messages.tr("decode", "de") != messages.tr("decode", "en") and messages.tr("nothing", "de") == "nothing"
    assert set(messages.MESSAGES["en"]) == set(messages.MESSAGES["de"])
