"""Readers that turn files into frames: films, pictures, animations, comic books and documents.

Frames are colour pictures (y, x, 3) of bytes. PNG and BMP are read here; other decoders are optional, and without one
a file gives a row without frames. Files are opened by path where they are read, and only the parts that a decoder asks
for are read, so no content is ever a value in a column.
"""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Callable, Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lookalike.functions import image
from lookalike.functions.paths import DOCUMENTS, IMAGES, VIDEOS

#: Shares of a file's length at which frames are taken, by suffix, and the length up to which only the first is.
SHARES = {"video": (0.15, 0.30, 0.50, 0.70, 0.85), "gif": (0.20, 0.40, 0.60, 0.80), "cbz": (0.0, 0.10, 0.30, 0.50), "pdf": (0.0, 0.30, 0.60)}
SHORT = {"video": 0, "gif": 3, "cbz": 4, "pdf": 3}
#: Longest side of a frame that is embedded, by mode, and of one whose sharpness is measured.
LARGEST, MEASURED = {"faces": 1024, "visual": 512}, 256
MOST_PAGES, PAGES = 50, ("png", "jpg", "jpeg", "webp")
#: Films show frames of less mean brightness, of all colours, too dark to tell; marks are looked for at this size.
LEAST_BRIGHTNESS, MARK_SIZE = 20.0, (90, 160)
#: A face is embedded if it is at least so probable, with so many pixels around it.
FACE_PROBABILITY, FACE_MARGIN = 0.95, 32
GREY = np.array([0.299, 0.587, 0.114])


def sampled(count: Column, sort: str) -> Column:
    """Indices of the sampled frames among `count`."""
    some = F.array_distinct(F.transform(F.array(*[F.lit(s) for s in SHARES[sort]]), lambda p: (count * p).cast("int")))
    if sort == "video":
        return F.when(count > 0, some).otherwise(F.array().cast("array<int>"))
    return F.when(count > SHORT[sort], some).when(count > 0, F.array(F.lit(0))).otherwise(F.array().cast("array<int>"))


def indices(count: int, sort: str) -> list[int]:
    if count <= 0:
        return []
    return list(dict.fromkeys(int(count * p) for p in SHARES[sort])) if count > SHORT[sort] else [0]


def film_facts(count: Column, fps: Column, codec: Column) -> Column:
    """struct(fps, duration, codec) of a film from its number of frames; without a rate it has no duration."""
    rate = F.when((fps > 0) & ~F.isnan(fps), fps).otherwise(0.0)
    return F.struct(rate.alias("fps"), F.when(rate > 0, count / rate).otherwise(0.0).alias("duration"), F.lower(F.trim(codec)).alias("codec"))


def largest_side(mode: str) -> int:
    return LARGEST.get(mode, 256)


def grey(frame: np.ndarray) -> np.ndarray:
    return frame[..., :3] @ GREY


def fitted(frame: np.ndarray, side: int) -> np.ndarray:
    """No side longer than `side`; shape kept, never enlarged."""
    most = max(frame.shape[:2])
    if most <= side:
        return frame
    height, width = (max(1, round(n * side / most)) for n in frame.shape[:2])
    return np.rint(image.shrink(frame[None].astype(np.float64), height, width)[0]).astype(frame.dtype)


def open_file(path: str) -> BinaryIO:
    """A seekable reader, on any file system that the workers know."""
    if "://" in path or path.startswith("file:"):
        from pyarrow import fs

        system, inner = fs.FileSystem.from_uri(path)
        return system.open_input_file(inner)
    return open(path, "rb")


def decode_bmp(content: bytes) -> np.ndarray:
    """Uncompressed bitmaps of 24 or 32 bits."""
    start, width, height, bits, packed = (int.from_bytes(content[a:b], "little", signed=True) for a, b in ((10, 14), (18, 22), (22, 26), (28, 30), (30, 34)))
    if bits not in (24, 32) or packed not in (0, 3):
        raise ValueError("kind of bitmap")
    step = -(-width * bits // 32) * 4
    rows = np.frombuffer(content, np.uint8, step * abs(height), start).reshape(abs(height), step)[:, : width * bits // 8]
    frame = rows.reshape(abs(height), width, bits // 8)[..., 2::-1]
    return frame[::-1] if height > 0 else frame


def decode_png(content: bytes) -> np.ndarray:
    """Pictures of 8 bits a channel without interlacing: grey, colour, palette, with or without transparency."""
    at, data, palette, head = 8, [], None, b""
    while at + 8 <= len(content):
        size, kind = int.from_bytes(content[at : at + 4], "big"), content[at + 4 : at + 8]
        body = content[at + 8 : at + 8 + size]
        at += size + 12
        if kind == b"IHDR":
            head = body
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            data.append(body)
    width, height = int.from_bytes(head[:4], "big"), int.from_bytes(head[4:8], "big")
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[head[9]]
    if head[8] != 8 or head[12]:
        raise ValueError("kind of picture")
    rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8, height * (width * channels + 1)).reshape(height, -1)
    out = np.zeros((height + 1, width + 1, channels), np.uint8)  # a border of zeros at the top and left
    for y, row in enumerate(rows, 1):
        line, above, sort = row[1:].reshape(width, channels), out[y - 1], row[0]
        if sort == 0:
            out[y, 1:] = line
        elif sort == 1:
            out[y, 1:] = np.cumsum(line, axis=0, dtype=np.uint64)
        elif sort == 2:
            out[y, 1:] = line + above[1:]
        else:
            for x in range(1, width + 1):
                left, up, corner = out[y, x - 1].astype(int), above[x].astype(int), above[x - 1].astype(int)
                guess = left + up - corner
                far = [np.abs(guess - p) for p in (left, up, corner)]
                paeth = np.where((far[0] <= far[1]) & (far[0] <= far[2]), left, np.where(far[1] <= far[2], up, corner))
                out[y, x] = (line[x - 1] + ((left + up) // 2 if sort == 3 else paeth)) & 255
    frame = out[1:, 1:]
    if head[9] == 3:
        return palette[frame[..., 0]]
    return frame[..., :3] if channels > 2 else np.repeat(frame[..., :1], 3, axis=2)


def decode_picture(content: bytes) -> np.ndarray | None:
    if content[:8] == b"\x89PNG\r\n\x1a\n":
        return decode_png(content)
    if content[:2] == b"BM":
        return decode_bmp(content)
    try:
        from PIL import Image
    except ImportError:
        return None
    try:
        from pillow_heif import register_heif_opener

        register_heif_opener()
    except ImportError:
        pass
    with Image.open(io.BytesIO(content)) as picture:
        return np.asarray(picture.convert("RGB"))


def read_picture(file: BinaryIO, path: str) -> tuple[list[np.ndarray], dict[str, object]]:
    one = decode_picture(file.read())
    return ([] if one is None else [one]), {}


def read_book(file: BinaryIO, path: str) -> tuple[list[np.ndarray], dict[str, object]]:
    """Sampled pages of a comic book archive, in order of name; of more than 50, every n-th is a page."""
    with zipfile.ZipFile(file) as book:
        names = sorted(n for n in book.namelist() if n.rsplit(".", 1)[-1].lower() in PAGES)
        if len(names) > MOST_PAGES:
            names = names[:: len(names) // MOST_PAGES][:MOST_PAGES]
        return [f for i in indices(len(names), "cbz") if (f := decode_picture(book.read(names[i]))) is not None], {}


def read_video(file: BinaryIO, path: str) -> tuple[list[np.ndarray], dict[str, object]]:
    """(sampled frames, facts) by OpenCV, which seeks in the file itself; dark frames are passed over. Without it, none."""
    try:
        import cv2
    except ImportError:
        return [], {}
    film = cv2.VideoCapture(path.removeprefix("file://").removeprefix("file:"))
    try:
        count, fps, code = (film.get(p) for p in (cv2.CAP_PROP_FRAME_COUNT, cv2.CAP_PROP_FPS, cv2.CAP_PROP_FOURCC))
        size = [int(film.get(p)) for p in (cv2.CAP_PROP_FRAME_WIDTH, cv2.CAP_PROP_FRAME_HEIGHT)]
        name = int(code).to_bytes(4, "little").decode("latin-1").strip("\0 ").lower()
        facts = {"fps": fps, "duration": count / fps if fps > 0 else 0.0, "codec": name, "resolution": f"{size[0]}x{size[1]}"}
        stills = []
        for i in indices(int(count), "video"):
            film.set(cv2.CAP_PROP_POS_FRAMES, i)
            ok, picture = film.read()
            if ok and picture.mean() > LEAST_BRIGHTNESS:
                stills.append(picture[..., ::-1])
        return stills, facts
    finally:
        film.release()


def read_pdf(file: BinaryIO, path: str) -> tuple[list[np.ndarray], dict[str, object]]:
    """Sampled pages at half size by pypdfium2. Without it, none."""
    try:
        import pypdfium2
    except ImportError:
        return [], {}
    book = pypdfium2.PdfDocument(file)
    return [np.asarray(book[i].render(scale=0.5).to_pil().convert("RGB")) for i in indices(len(book), "pdf")], {}


def read_animation(file: BinaryIO, path: str) -> tuple[list[np.ndarray], dict[str, object]]:
    """The sampled frames of a GIF by Pillow; no other frame is kept. Without it, none."""
    try:
        from PIL import Image
    except ImportError:
        return [], {}
    with Image.open(file) as film:
        stills = []
        for i in indices(getattr(film, "n_frames", 1), "gif"):
            film.seek(i)
            stills.append(np.asarray(film.convert("RGB")))
        return stills, {}


Reader = Callable[[BinaryIO, str], tuple[list[np.ndarray], dict[str, object]]]
#: Readers by suffix; replace or add entries for other decoders.
READERS: dict[str, Reader] = dict.fromkeys(VIDEOS, read_video) | dict.fromkeys(IMAGES, read_picture) | {"gif": read_animation, "cbz": read_book, "pdf": read_pdf}


def sharpness_of(frame: np.ndarray) -> float:
    return float(image.sharpness(grey(fitted(frame, MEASURED))[None])[0])


def chosen(suffix: str, stills: list[np.ndarray]) -> list[np.ndarray]:
    """The frames to embed: of books only the sharpest page, the first on ties; else all."""
    if suffix in ("cbz", "pdf") and stills:
        return [stills[int(np.argmax([sharpness_of(f) for f in stills]))]]
    return stills


Face = tuple[tuple[int, int, int, int], float]


def cropped(frame: np.ndarray, faces: list[Face], margin: int = FACE_MARGIN, least: float = FACE_PROBABILITY) -> np.ndarray | None:
    """The most probable face of a frame with a margin around it, if probable enough. Faces: ((left, top, right, bottom), probability)."""
    box, probability = max(faces, key=lambda f: f[1], default=((0, 0, 0, 0), 0.0))
    if not probability > least:
        return None
    left, top, right, bottom = box[0] - margin // 2, box[1] - margin // 2, box[2] + margin // 2, box[3] + margin // 2
    part = frame[max(0, top) : bottom, max(0, left) : right]
    return part if part.size else None


FEATURES = "path string, resolution string, duration double, codec string, fps double, frames int, dhash array<bigint>, sharpness double, watermark double, vector array<array<float>>, error string"
ROW = pa.schema(
    [
        ("path", pa.string()), ("resolution", pa.string()), ("duration", pa.float64()), ("codec", pa.string()), ("fps", pa.float64()), ("frames", pa.int32()), ("dhash", pa.list_(pa.int64())),
        ("sharpness", pa.float64()), ("watermark", pa.float64()), ("vector", pa.list_(pa.list_(pa.float32()))), ("error", pa.string()),
    ]
)
Embedder = Callable[[list[np.ndarray]], np.ndarray]
Detector = Callable[[np.ndarray], list[Face]]


def features(files: DataFrame, embedder: Callable[[], Embedder] | None = None, mode: str = "visual", detector: Callable[[], Detector] | None = None) -> DataFrame:
    """Catalog features of listed files (path).

    A file that can't be opened or decoded gives a row without frames and the reason. Decoding and embedding share
    one stage, so pixels never leave the worker. `embedder` is called once per task and returns a function
    from a list of colour frames, no side longer than the mode's, to as many vectors, which are brought to unit
    length; vectors of different files are made in one call per batch. Without it vector is null. In faces mode
    `detector`, called once per task, finds the faces of a frame, and the best face of each frame is embedded
    in the frame's place; a file without any has no vector.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = embedder() if embedder else None
        look = detector() if detector and mode == "faces" else None
        for batch in batches:
            rows, queue, owners = [], [], []
            for path in batch.column("path").to_pylist():
                name = path.rsplit("/", 1)[-1]
                end, stills, facts, error = name.rsplit(".", 1)[-1].lower() if "." in name[1:] else "", [], {}, None
                try:
                    if end in READERS:
                        with open_file(path) as file:
                            stills, facts = READERS[end](file, path)
                    if not stills:
                        error = "no decoder" if end in IMAGES + VIDEOS + DOCUMENTS else "unknown kind"
                except Exception as e:  # one unreadable file must not end the scan
                    error = type(e).__name__
                row = {"path": path, "frames": len(stills), "error": error, "resolution": f"{stills[0].shape[1]}x{stills[0].shape[0]}" if stills else None} | facts
                row["dhash"] = [int(image.frame_hash(grey(f)[None])[0]) for f in stills]
                row["sharpness"] = max(map(sharpness_of, stills), default=None)
                marks = np.array([image.shrink(grey(f)[None], *MARK_SIZE)[0] for f in stills]) if end in VIDEOS and stills else None
                row["watermark"] = 0.0 if marks is None else float(image.static_share(marks[None])[0])
                picked = [fitted(f, largest_side(mode)) for f in chosen(end, stills)] if model else []
                if look:
                    picked = [face for f in picked if (face := cropped(f, look(f))) is not None]
                queue += picked
                owners += [len(rows)] * len(picked)
                rows.append(row)
            if model and queue:
                vectors = np.asarray(model(queue), np.float32)
                norms = np.linalg.norm(vectors, axis=1, keepdims=True)
                for owner, v in zip(owners, vectors / np.where(norms > 0, norms, 1)):
                    rows[owner].setdefault("vector", []).append(v.tolist())
            yield pa.RecordBatch.from_pylist(rows, ROW)

    return files.select("path").mapInArrow(run, FEATURES)


#: Longest side and JPEG quality of a stored thumbnail.
THUMBNAIL = 640


def thumbnails(files: DataFrame, encode: Callable[[np.ndarray], bytes] | None = None) -> DataFrame:
    """(path, picture, ratio) of files whose first frame can be decoded: the frame at no more than 640 pixels a side, as
    `encode` writes it (JPEG by Pillow, where it is there; else PNG), and its content ratio."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for path in batch.column("path").to_pylist():
                end = path.rsplit(".", 1)[-1].lower()
                try:
                    with open_file(path) as file:
                        frame = fitted(READERS[end](file, path)[0][0], THUMBNAIL)
                    kept.append((path, (encode or encode_picture)(frame), float(image.lit_ratio(grey(frame)[None])[0])))
                except Exception:  # a file without a thumbnail is no error
                    continue
            columns = list(zip(*kept)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.binary()), pa.array(columns[2], pa.float64())], names=["path", "picture", "ratio"])

    return files.select("path").mapInArrow(run, "path string, picture binary, ratio double")


def encode_png(frame: np.ndarray) -> bytes:
    lines = np.concatenate([np.zeros((frame.shape[0], 1), np.uint8), frame.astype(np.uint8).reshape(frame.shape[0], -1)], axis=1)
    head = frame.shape[1].to_bytes(4, "big") + frame.shape[0].to_bytes(4, "big") + bytes([8, 2, 0, 0, 0])
    part = lambda kind, body: len(body).to_bytes(4, "big") + kind + body + zlib.crc32(kind + body).to_bytes(4, "big")
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", zlib.compress(lines.tobytes())) + part(b"IEND", b"")


def encode_picture(frame: np.ndarray) -> bytes:
    try:
        from PIL import Image
    except ImportError:
        return encode_png(frame)
    out = io.BytesIO()
    Image.fromarray(frame.astype(np.uint8)).save(out, "JPEG", quality=85)
    return out.getvalue()
