import pytest

pytest.importorskip("cellframe.llm")
