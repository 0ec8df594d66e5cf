import json
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from sessionlens.session import build_session  # noqa: E402
from sessionlens.sources.readers import parse_sessions  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session("local[8]", **{
        "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g",
        "spark.ui.showConsoleProgress": "false",
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoints"))})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def sid(number: int) -> str:
    return f"{number:08d}-0000-4000-8000-000000000000"


def record(number: int = 1, **fields) -> dict:
    return {"session_id": sid(number), "status": "passed", **fields}


def turn(number: int, speaker: str, text: str, **fields) -> dict:
    return {"turn_id": number, "speaker": speaker, "text": text, **fields}


def llm(number: int, **fields) -> dict:
    return {"call_id": f"llm_{number}", "model_name": "m", **fields}


def tool(number: int, **fields) -> dict:
    return {"call_id": f"tool_{number}", "tool_name": "search", **fields}


def event(number: int, kind: str = "METRIC", second: int | None = None, **fields) -> dict:
    stamp = {} if second is None else {"timestamp": f"2026-01-01T00:{second // 60:02d}:{second % 60:02d}Z"}
    return {"event_id": f"e{number}", "event_type": kind, **stamp, **fields}


@pytest.fixture
def sessions(spark):
    """Nested session rows from dictionaries; every one must be valid."""
    def make(*records):
        lines = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)], "row_id bigint, value string")
        parsed = parse_sessions(lines)
        assert parsed.where("size(issues) > 0").select("issues").collect() == []
        return parsed.drop("issues")
    return make
