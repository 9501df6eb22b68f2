import re
import time
from pathlib import Path

from gridloom.llm.common import Scratch


def test_written_tables_give_freed_native_memory_back(spark):
    """4000 blocks of 60 kB are freed between blocks that stay, so the C library keeps them until it is told."""
    jvm = spark.sparkContext._jvm
    status = Path(f"/proc/{jvm.java.lang.ProcessHandle.current().pid()}/status")
    resident = lambda: int(re.search(r"RssAnon:\s+(\d+)", status.read_text())[1]) / 1024
    field = jvm.java.lang.Class.forName("sun.misc.Unsafe").getDeclaredField("theUnsafe")
    field.setAccessible(True)
    unsafe = field.get(None)
    scratch = Scratch(spark)
    scratch.table(spark.range(10).toDF("x"))
    blocks = [unsafe.allocateMemory(60_000) for _ in range(4000)]
    for b in blocks:
        unsafe.setMemory(b, 60_000, 1)
    for i, b in enumerate(blocks):
        if i % 50:
            unsafe.freeMemory(b)
    before = resident()
    began = time.time()
    kept = scratch.table(spark.range(10).toDF("x"))
    after = resident()
    for b in blocks[::50]:
        unsafe.freeMemory(b)
    assert kept.count() == 10
    assert before - after > 100, (before, after, time.time() - began)
