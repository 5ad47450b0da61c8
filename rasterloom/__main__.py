"""python -m rasterloom encode IN [OUT] | decode IN [OUT] | benchmark IN [-n N]: single files."""

from __future__ import annotations

import argparse
import sys
import time
from pathlib import Path

from .operators import container
from .sources import netpbm


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="rasterloom")
    sub = parser.add_subparsers(dest="job", required=True)
    for job in ("encode", "decode", "benchmark"):
        p = sub.add_parser(job)
        p.add_argument("input", type=Path)
        if job == "benchmark":
            p.add_argument("-n", "--iterations", type=int, default=10)
        else:
            p.add_argument("output", type=Path, nargs="?")
    a = parser.parse_args(argv)
    try:
        raw = a.input.read_bytes()
        if a.job == "encode":
            w, h, bits, n, data = netpbm.parse(raw)
            out = container.encode(data, w, h, bits, n, container.Options(mode=container.NONE if n == 1 else 2, spiff={}))
            (a.output or a.input.with_suffix(".jls")).write_bytes(out)
        elif a.job == "decode":
            r, data = container.decode(raw)
            if r.count > 1 and r.scans[0].mode == container.NONE:  # planes become pixels
                data = container.planes_to_bytes(container.bytes_to_planes(data, r.width, r.height, r.bits, r.count, False), r.bits, True)
            (a.output or a.input.with_suffix(".pgm" if r.count == 1 else ".ppm")).write_bytes(netpbm.build(r.width, r.height, r.bits, r.count, data))
        else:
            container.decode(raw)
            start = time.perf_counter()
            for _ in range(a.iterations):
                container.decode(raw)
            print(f"mean decode: {(time.perf_counter() - start) * 1000 / max(1, a.iterations):.1f} ms")
    except (OSError, ValueError) as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
