"""Styles, certification, overlays and image bytes."""

from __future__ import annotations

import numpy as np
import pytest

from sparkgauge.operators import generate, raster, render

MASK = raster.draw(120, 120, [([(20, 20), (20, 100), (100, 100)], 16)])
ENDS = ((20, 20), (100, 100))


@pytest.mark.parametrize("name", list(render.STYLES))
def test_every_style_is_certified_and_repeats(name):
    pixels, rejected = render.certified(MASK, name, 5, *ENDS)
    assert len(rejected) < render.RESAMPLES and (pixels == render.certified(MASK, name, 5, *ENDS)[0]).all()
    assert (pixels != render.paint(MASK, name, 99, *ENDS)).any()


def test_certification_catches_what_it_should():
    look = render.sample("notebook", 1)
    fake = render.paint(MASK, "notebook", 1, *ENDS)
    fake[40:70, 28:50] = look.corridor  # a false branch
    assert "extension" in render.certify(fake, MASK, look, list(ENDS)) or "edge" in render.certify(fake, MASK, look, list(ENDS))
    wall = render.paint(MASK, "notebook", 1, *ENDS)
    wall[45:80, 12:28] = (0, 0, 0)
    assert "interior" in render.certify(wall, MASK, look, list(ENDS))
    assert "marker" in render.certify(render.paint(MASK, "notebook", 1), MASK, look, list(ENDS))


def test_variants_overlays_and_png(spark, tmp_path):
    image = render.paint(MASK, "volcanic", 1)
    assert (render.variant("blank", image) == 255).all() and render.variant("rescale", image, scale=0.5).shape == (60, 60, 3)
    assert (render.rescale(image, 1.0) == image).all() and render.variant("mismatched", image, image[::-1])[0, 0].tolist() == image[-1, 0].tolist()
    with pytest.raises(ValueError):
        render.variant("mismatched", image)
    assert (render.overlay(image, [(20, 20), (20, 100)], False, (20, 60))[60, 20] == (255, 0, 255)).all()
    (tmp_path / "a.png").write_bytes(render.png(np.where(MASK, 255, 0).astype(np.uint8)))
    r = spark.read.format("image").load(f"file://{tmp_path}").first().image
    assert (np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, -1)[:, :, 0] > 127).tolist() == MASK.tolist()


def test_no_image_is_returned_that_fails(monkeypatch):
    monkeypatch.setattr(render, "certify", lambda *a: ["edge"])
    with pytest.raises(ValueError, match="notebook.*6 tries"):
        render.certified(MASK, "notebook", 1, *ENDS)


def test_worlds_in_all_styles(spark):
    rows = render.render_all(generate.build_split(spark, 2)).select("slot", "style", "failures").collect()
    assert len(rows) == 40 and sum(not r.failures for r in rows) >= 38
