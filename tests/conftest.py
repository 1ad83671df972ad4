import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from factloom.session import local_session

    s = local_session(4, "4g", "tests")
    s.conf.set("spark.sql.shuffle.partitions", "4")
    s.sparkContext.setLogLevel("ERROR")
    return s


SYMBOL = "symbol_id string, file_id string, name string, qualified_name string, kind string, start_line int, end_line int, parent_symbol_id string, decorators array<string>, base_classes array<string>, is_async boolean, is_generator boolean, usr string, summary string"
FILE = "file_id string, project_id string, relative_path string, language string, content_hash string, last_analyzed_at timestamp_ntz, analysis_status string, analyzer_version string"


@pytest.fixture(scope="session")
def make(spark):
    """Small tables by name: rows are given as dicts, missing columns are null; 'sid' and 'total' are extra columns with clashing names."""

    def table(schema: str, rows: list[dict], extra: bool = True):
        schema = schema + (", sid string, total long" if extra else "")
        names = [x.strip().split()[0] for x in schema.split(", ")]
        return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema)

    return table
