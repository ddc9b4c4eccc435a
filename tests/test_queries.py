"""A choice of registered queries against their SQL, one or more per operator family.

``python compare.py`` runs all of them.
"""

import os

import pytest

import __spark_entry__ as contract
from compare import compare, connect

ROOT = "/root/testdata/sf0.001"
CHOSEN = [
    "stable_ids", "message_search_page", "message_search_media", "search_page_hydrated", "context_windows_corpus",
    "conversation_roster_large", "digest_counts_all", "candidate_merge", "message_merge", "roster_merge", "export_dedupe",
    "resume_decisions", "self_resolution", "roster_with_observed", "resource_lookup", "typed_parts_resources",
    "transition_log", "watermark_change_summary", "generation_verification", "snapshot_profile", "manifest_flatten_parts",
    "group_export_scan", "stream_watermark_fold", "binary_file_scan",
]

pytestmark = pytest.mark.skipif(not os.path.isdir(ROOT), reason="test tables are absent")


@pytest.fixture(scope="module")
def con():
    return connect(ROOT)


@pytest.mark.parametrize("name", CHOSEN)
def test_query_matches_sql(spark, con, name):
    good, note = compare(spark, con, name, ROOT)
    assert good, note


def test_every_query_has_sql():
    from evidentia.plans import registry

    assert set(registry.load()) <= set(contract.oracle_sql())


def test_entry(spark):
    assert contract.entry(spark).count() > 0
