"""Page images as base64 PNG: the part below a share of the page, and smaller copies. Needs an imaging library; without it, and for
bytes that are no image, results are None and the caller goes on with what it has."""

from __future__ import annotations

import base64
import binascii
import io

from pyspark.sql import Column

from quire.operators.udf import rowwise
from quire.sources.pdf import fitted_size


def _opened(data: str | None):
    try:
        from PIL import Image

        return Image.open(io.BytesIO(base64.b64decode("".join((data or "").partition(",")[2].split() or (data or "").split()))))
    except (ImportError, OSError, binascii.Error, ValueError):
        return None


def _png(image) -> str:
    out = io.BytesIO()
    image.convert("RGB").save(out, "PNG")
    return base64.b64encode(out.getvalue()).decode()


def below(data: str | None, share: float = 0.45) -> str | None:
    """The image below a share of its height."""
    image = _opened(data)
    if image is None or not 0 <= share < 1:
        return None
    top = int(image.height * share)
    return _png(image.crop((0, top, image.width, image.height))) if top < image.height else None


def smaller(data: str | None, max_edge: int) -> str | None:
    """The image with its longer edge at most max_edge; None if it is small enough as it is."""
    image = _opened(data)
    size = fitted_size(image.width, image.height, max_edge) if image is not None else None
    return _png(image.resize(size)) if size and size != (image.width, image.height) else None


def cropped(image_base64: Column, share: float = 0.45) -> Column:
    return rowwise(lambda d: below(d, share), "string")(image_base64)


def downscaled(image_base64: Column, max_edge: int) -> Column:
    """Column of smaller images, the given ones where there is no smaller."""
    return rowwise(lambda d: smaller(d, max_edge) or d, "string")(image_base64)
