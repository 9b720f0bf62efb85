"""Stated limits are errors that say so."""

import pytest

from hitloom.llm import media


def test_files_that_do_not_fit_in_a_value(monkeypatch):
    size = len(media.encode_avi(bytes(640)))
    monkeypatch.setattr(media, "CELL", size)
    assert len(media.encode_avi(bytes(640))) == size
    monkeypatch.setattr(media, "CELL", size - 1)
    with pytest.raises(ValueError, match="does not fit"):
        media.encode_avi(bytes(640))
    monkeypatch.setattr(media, "MOST", 600)
    with pytest.raises(ValueError, match="may not fit"):
        media.encode_avi(bytes(640))
