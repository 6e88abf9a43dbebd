"""What the headers of images and films say, for sources.files.binary_texts."""

from __future__ import annotations

import struct

#: TIFF tags that are read. Fixed values.
TAGS = {270: "Description", 271: "Camera make", 272: "Camera model", 305: "Software", 306: "Changed", 315: "Artist", 33432: "Copyright", 36867: "Date taken"}
EXIF_POINTER = 34665


def tiff_tags(data: bytes) -> dict[str, str]:
    """The text tags of a TIFF header and of the EXIF part that it points to."""
    order = "<" if data[:2] == b"II" else ">"
    out: dict[str, str] = {}

    def read(at: int, deep: bool) -> None:
        (n,) = struct.unpack_from(order + "H", data, at)
        for i in range(n):
            tag, kind, count, value = struct.unpack_from(order + "HHII", data, at + 2 + 12 * i)
            if tag in TAGS and kind == 2:
                start = value if count > 4 else at + 2 + 12 * i + 8
                out[TAGS[tag]] = data[start : start + count].split(b"\0")[0].decode("utf-8", "replace").strip()
            elif tag == EXIF_POINTER and deep:
                read(value, False)

    read(struct.unpack_from(order + "I", data, 4)[0], True)
    return out


def jpeg_text(data: bytes) -> str:
    """The size and the text tags of a JPEG image, one a line. Raises ValueError for other files."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("no JPEG image")
    lines, at = [], 2
    while at + 4 <= len(data) and data[at] == 0xFF and data[at + 1] != 0xDA:
        mark, length = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        part = data[at + 4 : at + 2 + length]
        if mark == 0xE1 and part[:6] == b"Exif\0\0":
            lines += [f"{k}: {v}." for k, v in tiff_tags(part[6:]).items() if v]
        elif 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
            height, width = struct.unpack_from(">HH", part, 1)
            lines.insert(0, f"Image is {width}x{height} pixels.")
        at += 2 + length
    return "\n".join(lines)


def film_text(data: bytes) -> str:
    """The kind and length of an MP4 or MOV film. Raises ValueError for other files."""
    lines: list[str] = []

    def boxes(low: int, high: int) -> None:
        at = low
        while at + 8 <= high:
            size, kind = struct.unpack_from(">I4s", data, at)
            head = 8
            if size == 1:
                size, head = struct.unpack_from(">Q", data, at + 8)[0], 16
            size = size or high - at
            if size < head:
                return
            if kind == b"ftyp":
                lines.append(f"Container is {data[at + head : at + head + 4].decode('latin-1').strip()}.")
            elif kind == b"moov":
                boxes(at + head, min(high, at + size))
            elif kind == b"mvhd":
                wide = data[at + head] == 1
                scale, length = struct.unpack_from(">IQ" if wide else ">II", data, at + head + (20 if wide else 12))
                lines.append(f"Film lasts {length / max(scale, 1):.1f} seconds.")
            at += size

    if data[4:8] != b"ftyp":
        raise ValueError("no MP4 film")
    boxes(0, len(data))
    return "\n".join(lines)
