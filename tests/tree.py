"""A tree of files: a node of order k has file0.., dir0.. up to k-1, dir_i being a node of order i, and a link at order 3."""

from __future__ import annotations

import os


def make_tree(path: str, order: int) -> None:
    os.makedirs(path, exist_ok=True)
    for i in range(order):
        open(os.path.join(path, f"file{i}"), "w").close()
        make_tree(os.path.join(path, f"dir{i}"), i)
    if order == 3:
        os.symlink("./file1", os.path.join(path, "randomSymlink"))


def write(path: str, text: str) -> None:
    with open(path, "w") as f:
        f.write(text)
