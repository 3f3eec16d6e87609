"""Glyphs for the box proof."""

from tests.test_glyphs import frame, written


def glyph_frame(spark, text, x, top):
    return frame(spark, written(text, x=x, top=top))
