"""The general decoder against images of an encoder made elsewhere, Java's, and against this one's own."""

import numpy as np
import pytest

from semforge.llm import jpeg, media


def java_jpeg(spark, image, progressive, quality):
    """(bytes, samples) of Java's encoder and decoder; image is (rows, columns) or (rows, columns, 3)."""
    jvm = spark._jvm
    jvm.java.lang.System.setProperty("java.awt.headless", "true")
    rows, columns = image.shape[:2]
    gray = image.ndim == 2
    buffered = jvm.java.awt.image.BufferedImage(columns, rows, 10 if gray else 1)
    bands = image[:, :, None] if gray else image
    raster = buffered.getRaster()
    for b in range(bands.shape[2]):
        flat = bands[:, :, b].ravel().tolist()
        values = spark.sparkContext._gateway.new_array(jvm.int, len(flat))
        for k, v in enumerate(flat):
            values[k] = v
        raster.setSamples(0, 0, columns, rows, b, values)
    writer = jvm.javax.imageio.ImageIO.getImageWritersByFormatName("jpeg").next()
    param = writer.getDefaultWriteParam()
    param.setCompressionMode(2)
    param.setCompressionQuality(quality)
    param.setProgressiveMode(1 if progressive else 0)
    out = jvm.java.io.ByteArrayOutputStream()
    stream = jvm.javax.imageio.ImageIO.createImageOutputStream(out)
    writer.setOutput(stream)
    writer.write(None, jvm.javax.imageio.IIOImage(buffered, None, None), param)
    stream.flush()
    raw = bytes(out.toByteArray())
    back = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(raw)).getRaster()
    got = [np.array(list(back.getSamples(0, 0, columns, rows, b, spark.sparkContext._gateway.new_array(jvm.int, rows * columns)))).reshape(rows, columns) for b in range(bands.shape[2])]
    return raw, np.stack(got, 2)


@pytest.mark.parametrize("progressive", [True, False])
@pytest.mark.parametrize("quality", [0.95, 0.4])
def test_images_of_another_encoder(spark, progressive, quality):
    rng = np.random.default_rng(5)
    y, x = np.mgrid[0:37, 0:51]
    gray = np.clip(128 + 70 * np.sin(x / 5) + 40 * np.cos(y / 3) + rng.normal(0, 12, x.shape), 0, 255).astype(np.uint8)
    gray[:, :20] = 200
    raw, want = java_jpeg(spark, gray, progressive, quality)
    got = jpeg.Decoder(raw)
    assert got.progressive == progressive and got.rgb().shape == (37, 51, 3)
    assert np.abs(got.rgb()[:, :, :1].astype(int) - want).max() <= 1
    # Chroma that changes slowly: how it is interpolated makes little difference.
    colour = np.stack([gray, np.clip(gray.astype(int) + x // 4, 0, 255), np.full_like(gray, 90)], 2).astype(np.uint8)
    raw, want = java_jpeg(spark, colour, progressive, quality)
    assert np.abs(jpeg.Decoder(raw).rgb().astype(int) - want).mean() <= 4


def test_own_images_and_broken_ones(spark):
    texts = [b"some text " * 50, b"", bytes(range(256)) * 9]
    payloads = [np.frombuffer(t.ljust(max(1, -(-len(t) // 576)) * 576, b"\xff"), np.uint8) for t in texts]
    stored = media.encode(payloads)
    c, begin, about = media.coefficients(stored)
    for k, raw in enumerate(stored):
        x = jpeg.Decoder(raw)
        tiles = media.rgb(media.samples(c[begin[k] : begin[k + 1]]))
        assert np.array_equal(x.rgb(), media.tensor(tiles, *about[k][1:]))
    rows = [(k, bytearray(raw), "h") for k, raw in enumerate(stored)] + [(7, bytearray(stored[0][:200]), "h"), (8, bytearray(b"nothing"), "h"), (9, None, "h")]
    out = {r.id: r for r in jpeg.decoded_images(spark.createDataFrame(rows, "id int, media binary, height string")).collect()}
    assert len(out) == len(rows) and all(len(out[k].rgb) == 3 * out[k].height * out[k].width and out[k].decode_error is None for k in range(len(stored)))
    assert out[7].rgb is None and out[7].decode_error and out[8].decode_error == "not a JPEG" and out[9].rgb is None and out[9].decode_error is None
    assert jpeg.decoded_images(spark.createDataFrame([], "media binary")).count() == 0


def test_empty_media(spark):
    assert media.media_columns(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    wide = spark.createDataFrame([(1, "a", "x", "y")], "doc_id long, text string, media string, feature string")
    r = media.media_columns(wide, keep_rgb=True).first()
    assert r.n_bytes == 1 and len(r.rgb) == 3 * r.height * r.width
