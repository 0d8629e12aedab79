"""Text of a table as one file: parts that the tasks write, joined by the driver as a stream."""

from __future__ import annotations

import posixpath
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bam import COPY, _system


def write(lines: DataFrame, path: str, head: list[str] = (), force: bool = False) -> None:
    """Writes a column ``value`` behind the lines of ``head``, in the order of its partitions; an existing file stays without ``force``."""
    system, place = _system(path)
    if not force and system.get_file_info(place).type.name != "NotFound":
        raise FileExistsError(f"{path} exists")
    parts, private = f"{path}.parts-{uuid.uuid4().hex}", f"{place}.{uuid.uuid4().hex}"
    try:
        lines.select(F.col("value")).write.text(parts)
        from pyarrow import fs

        found = system.get_file_info(fs.FileSelector(_system(parts)[1]))
        names = sorted(f.path for f in found if posixpath.basename(f.path).startswith("part-"))
        with system.open_output_stream(private, compression=None) as out:
            out.write("".join(f"{line}\n" for line in head).encode())
            for name in names:
                with system.open_input_stream(name, compression=None) as raw:
                    while data := raw.read(COPY):
                        out.write(data)
        system.move(private, place)
    finally:
        folder = _system(parts)[1]
        if system.get_file_info(folder).type.name != "NotFound":
            system.delete_dir(folder)
