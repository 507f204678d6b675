"""A generated corpus of small workloads: the inputs of the comparison matrix. Everything follows from the recipes below."""

from __future__ import annotations

import hashlib
import json
import os
from pathlib import Path

_MASK = (1 << 64) - 1


def noise(n: int, seed: int) -> bytes:
    """n bytes of a shift-register generator (13, 7, 17)."""
    out, s = bytearray(), seed
    for i in range(n):
        s = (s + i) & _MASK
        s ^= s << 13 & _MASK
        s ^= s >> 7
        s ^= s << 17 & _MASK
        out.append(s >> 48 & 255)
    return bytes(out)


# The snippet of the source-like workload.
_SNIPPET = """fn main() {
    let x = 1usize;
    let y = x + 2;
    println!("{}", y);
    mod inner {
        pub fn f(z: u32) -> u32 { z.wrapping_mul(3) }
    }
}
"""


def _lines(n: int, line) -> bytes:
    return "".join(line(i) for i in range(n)).encode()


def recipes(large: bool = False) -> dict[str, bytes]:
    """Path in the corpus -> content."""
    near = bytearray(_lines(900, lambda i: "nearly the same content block 0123456789abcdef\n"))
    files = {
        "wl_01_very_small_text/tiny_a.txt": b"hi\n",
        "wl_01_very_small_text/tiny_b.txt": b"x",
        "wl_02_medium_text/medium.txt": _lines(800, lambda i: f"word_{i} some text value={i % 97}\n"),
        "wl_03_large_text/large.txt": _lines(12000, lambda i: f"paragraph {i} lorem ipsum dolor sit amet {i % 50}\n"),
        "wl_04_highly_repetitive/repetition.txt": b"A" * 200_000,
        "wl_05_mixed_text_numbers/mixed.txt": _lines(3000, lambda i: f"row {i} count {3 * i} label {i % 13}\n"),
        "wl_06_json_like/data.jsonish": b"[\n" + _lines(400, lambda i: f'{{"id":{i},"tag":"v","ok":true}},\n') + b"]",
        "wl_07_csv_like/table.csv": b"id,name,value,score\n" + _lines(2000, lambda i: f"{i},cell{i},{i % 7},{13 * i % 1000}\n"),
        "wl_08_log_like/app.log": _lines(2500, lambda i: f"2024-01-{i % 28 + 1:02}T10:{i % 60:02}:00Z INFO event={i % 500} bytes={17 * i}\n"),
        "wl_09_source_like/sample.rs": _lines(400, lambda i: f"// block {i}\n{_SNIPPET}"),
        "wl_10_binary_like/bytes.dat": b"".join(bytes(range(256)) + bytes([i & 255]) for i in range(600)),
        "wl_11_random_entropy/rnd.bin": noise(180_000, 0xDEADBEEFCAFE),
        "wl_12_duplicate_heavy/dup.txt": b"duplicate_block_marker;\n" * 48_000,
        "wl_13_near_duplicate/a.txt": bytes(near),
    }
    near[42] += 1
    files["wl_13_near_duplicate/b.txt"] = bytes(near)
    files |= {f"wl_14_nested_many_small/{d // 12}/{d % 12}/f{d}.txt": f"small file index {d} data {d % 3}\n".encode() for d in range(35)}
    if large:
        files["wl_15_large/blob.bin"] = noise(65_536, 0x1234) * 32
    return files | {
        "wl_16_mixed_combined/text/readme.txt": b"readme mixed workload\n" * 400,
        "wl_16_mixed_combined/bin/part.dat": noise(40_000, 0x55AA),
        "wl_16_mixed_combined/dup/one.txt": b"shared payload xyz\n" * 2000,
        "wl_16_mixed_combined/dup/two.txt": b"shared payload xyz\n" * 2000,
        "wl_16_mixed_combined/csv/summary.csv": b"k,v,n\n" + _lines(600, lambda i: f"{i},{i % 9},{i % 41}\n"),
    }


def generate(root: str, large: bool = False) -> dict:
    """Writes the corpus under root and returns its manifest."""
    files = recipes(large)
    for path, content in files.items():
        to = Path(root, path)
        to.parent.mkdir(parents=True, exist_ok=True)
        to.write_bytes(content)
    return {"version": 1, "generator": "bytegrain", "files": [{"path": p, "bytes": len(c), "sha256_hex": hashlib.sha256(c).hexdigest()} for p, c in sorted(files.items())]}


def write_manifest(path: str, manifest: dict) -> None:
    Path(path).write_text(json.dumps(manifest, indent=2))


def workload_dirs(root: str) -> list[str]:
    """Folders named wl_*, by name."""
    return sorted(e.path for e in os.scandir(root) if e.is_dir() and e.name.startswith("wl_"))
