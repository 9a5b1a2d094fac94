"""Registered queries against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

CHOSEN = ["map_units", "rounding", "round_area", "area_relations", "aspect_ratio", "density", "row_col_sums", "valid_split_range", "weighted_median_split", "empty_runs", "bisect_one_level", "sea_merge", "node_areas", "way_areas", "relation_areas", "area_overlaps", "distinct_to_real", "relation_filter", "display_names", "descendants", "relation_loops", "way_bbox_areas", "segment_areas", "best_city", "solved_nodes", "tile_files_pbf", "areas_list", "areas_kml", "areas_poly", "areas_outline", "template_args", "problem_report", "density_file", "city_file", "sea_index", "decimal_strings", "rounding_sweep", "valid_nodes", "clockwise_rings", "crossing_ways", "element_counts", "elements_xml", "bounds_xml", "node_file_pbf", "node_file_o5m", "node_file_xml", "disjoint_extents", "planet_cover", "neighbour_pairs", "region_areas", "area_names", "unnamed_areas", "rectangle_counts", "trimmed_map", "masked_counts", "split_positions", "solution_metrics", "unequal_tile_nodes", "unequal_tile_boxes", "pseudo_area_nodes", "pseudo_one_tile_relations", "needed_nodes", "ring_junctions", "nodes_in_polygons", "cells_in_polygons", "bisect_tiles"]


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{sf}/{f}')")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", CHOSEN)
def test_query(spark, sf, duck, name):
    got, want = entry.queries()[name](spark, sf).toPandas(), duck.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    assert entry.entry(spark).columns == ["area_idx", "n"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
