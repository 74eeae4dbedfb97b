"""A sample of the registered queries against their SQL, and the contract's shape."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

from conftest import SF

SOME = ["c1_trim_alleles", "c8_expand_repeats", "h2_resolve_hgvs", "h4_format_hgvs_protein", "p3_transcript_to_protein_change", "c3_classify", "c4_left_aligned", "p4_effect_labels", "r5_clip_alignment", "r14_select_best_alignment", "j2_map_from_main_genome", "j5_to_spliced",
        "w7_rebuild_identifier_index", "q6_alleles_by_gene_and_mutation", "q8_alleles_by_name", "x5_links_by_ids", "x6_render_link_templates", "h9_parse_short_ids", "s8_read_transcript_meta"]


def values(rows, cols):
    return sorted(tuple(str(r[c]) for c in cols) for r in rows)


@pytest.mark.parametrize("name", SOME)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in got.description]
    assert cols == sorted(names)
    assert values([r.asDict() for r in df.collect()], cols) == values([dict(zip(names, r)) for r in got.fetchall()], cols)


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
