"""The cycle collector rests while texts are searched."""

from __future__ import annotations

import gc

import pytest

from quire.llm import pieces


def test_collector_rests_and_comes_back():
    assert gc.isenabled()
    with pieces.uncollected():
        assert not gc.isenabled()
    assert gc.isenabled()
    with pytest.raises(ValueError), pieces.uncollected():
        raise ValueError
    assert gc.isenabled()
    gc.disable()
    try:
        with pieces.uncollected():
            pass
        assert not gc.isenabled()
    finally:
        gc.enable()
