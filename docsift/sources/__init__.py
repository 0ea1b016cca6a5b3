"""Sources and sinks: driver test tables, text files, JSON batches, snapshots."""

from docsift.sources.testdata import (  # noqa: F401
    AS_OF,
    documents_from_testdata,
    read_table,
    vectors_from_testdata,
)
