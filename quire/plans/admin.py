"""The registry and what is known of its documents: list, add, remove, reset, health, and both as text."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions import text as T
from ..operators.chunks import counts_by_type
from ..sources.files import TABLES, Store


@dataclass(frozen=True)
class Settings:
    """What an environment file sets."""

    embed_model: str = "BAAI/bge-large-en-v1.5"
    use_openvino: bool = False

    @staticmethod
    def of(lines: str) -> Settings:
        pairs = dict(x.strip().split("=", 1) for x in lines.splitlines() if "=" in x and not x.lstrip().startswith("#"))
        named = {k.strip(): v.strip().strip("'\"") for k, v in pairs.items()}
        return Settings(named.get("EMBED_MODEL") or Settings.embed_model, named.get("USE_OPENVINO") == "1")

    def lines(self) -> str:
        return f"EMBED_MODEL={self.embed_model}\nUSE_OPENVINO={int(self.use_openvino)}\n"


def documents_status(registry: DataFrame, chunks: DataFrame, registers: DataFrame) -> DataFrame:
    """registry with chunk_count and register_count."""
    counted = [t.groupBy("doc_id").agg(F.count("*").alias(n)) for t, n in ((chunks, "chunk_count"), (registers, "register_count"))]
    joined = registry
    for c in counted:
        joined = joined.join(c, "doc_id", "left")
    return joined.withColumns({n: F.coalesce(n, F.lit(0)) for n in ("chunk_count", "register_count")})


class Admin:
    """The registry file of a store and the documents behind it."""

    def __init__(self, store: Store, registry_path: str, pdf_root: str):
        self.store, self.registry_path, self.pdf_root = store, registry_path, pdf_root.rstrip("/")

    def _load(self) -> list[dict]:
        fs, where = self.store._files(self.registry_path)
        if not fs.exists(where):
            return []
        return json.loads("\n".join(r[0] for r in self.store.spark.read.text(self.registry_path, wholetext=True).collect()))

    def _save(self, entries: list[dict]) -> None:
        fs, where = self.store._files(self.registry_path)
        out = fs.create(where, True)
        out.write(bytearray(json.dumps(entries, indent=2, ensure_ascii=False).encode()))
        out.close()

    def registry(self) -> DataFrame:
        return self.store.spark.createDataFrame([(*(e.get(c) for c in ("doc_id", "revision", "chip_part", "path")), i) for i, e in enumerate(self._load())], f"{schemas.REGISTRY}, line_no long")

    def _exists(self, path: str) -> bool:
        fs, where = self.store._files(path)
        return fs.exists(where)

    def list_documents(self) -> list[dict]:
        counts = documents_status(self.registry(), self.store.read("chunks", schemas.CHUNKS), self.store.read("registers", schemas.REGISTERS)).orderBy("line_no").collect()
        out = []
        for r in counts:
            inside = r["path"].removeprefix(f"{self.pdf_root}/") if r["path"].startswith(f"{self.pdf_root}/") else None
            folder = "" if inside is None else inside.rpartition("/")[0] or "."
            out.append({c: r[c] for c in ("doc_id", "revision", "chip_part", "path", "chunk_count", "register_count")} | {"pdf_exists": self._exists(r["path"]), "folder": folder})
        return out

    def add_document(self, doc_id: str, revision: str, chip_part: str, folder: str, source: str) -> dict:
        """Copies the file under the root and registers it; an id that is there already is an error."""
        entries = self._load()
        if doc_id in {e["doc_id"] for e in entries}:
            raise ValueError(f"doc_id {doc_id!r} already exists in the registry")
        path = "/".join(x for x in (self.pdf_root, folder.strip("/"), source.rpartition("/")[2]) if x)
        (fs, where), (to, there) = self.store._files(source), self.store._files(path)
        self.store.spark._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, where, to, there, False, True, self.store.spark._jsc.hadoopConfiguration())
        entry = {"doc_id": doc_id, "revision": revision, "chip_part": chip_part, "path": path}
        self._save([*entries, entry])
        return entry

    def remove_document(self, doc_id: str, wipe_data: bool = False) -> None:
        """Leaves the registry; its rows go only with wipe_data, and no other document's."""
        self._save([e for e in self._load() if e["doc_id"] != doc_id])
        if wipe_data:
            for name in TABLES:
                if self.store.exists(name):
                    self.store.delete_document(name, doc_id)

    def reset(self) -> None:
        """All derived tables go; the registry and the files stay."""
        self.store.wipe()

    def health(self) -> dict:
        counts = {r["element_type"]: r["n"] for r in counts_by_type(self.store.read("chunks", schemas.CHUNKS)).collect()}
        return {
            "total_chunks": sum(counts.values()),
            "counts_by_type": counts,
            "register_count": self.store.read("registers", schemas.REGISTERS).count(),
            "general_table_count": self.store.read("general_tables", schemas.GENERAL_TABLES).count(),
            "last_indexed": self.store.last_written("index"),
        }

    def documents_markdown(self) -> str:
        rows = self.list_documents()
        if not rows:
            return "_No documents yet._"
        listed = self.store.spark.createDataFrame([(i, r["doc_id"], r["chip_part"], r["folder"], r["pdf_exists"], r["chunk_count"], r["register_count"]) for i, r in enumerate(rows)], "i int, d string, c string, f string, p boolean, n long, r long")
        line = T.document_line(F.col("d"), F.col("c"), F.col("f"), T.status_badge(F.col("p"), F.col("n")), F.col("n"), F.col("r"))
        return "\n".join(["| Document | Chip | Folder | Status | Chunks | Registers |", "|---|---|---|---|---|---|", *(r[0] for r in listed.orderBy("i").select(line).collect())])

    def health_markdown(self) -> str:
        h = self.health()
        said = [f"**Total chunks:** {h['total_chunks']}", f"**Registers:** {h['register_count']}", f"**General tables:** {h['general_table_count']}"]
        if h["counts_by_type"]:
            said.append("**By type:** " + ", ".join(f"{k}={n}" for k, n in sorted(h["counts_by_type"].items())))
        said.append(f"**Last indexed:** {datetime.fromtimestamp(h['last_indexed']) if h['last_indexed'] else 'never'}")
        return "\n\n".join(said)

    def trigger_ingest(self, doc_id: str, ingest) -> Iterator[str]:
        """The progress lines of one document's ingest; ingest: as plans.ingest.Ingest."""
        yield from ingest.run(self.registry(), only_doc_id=doc_id)

    def save_settings(self, path: str, settings: Settings) -> dict:
        fs, where = self.store._files(path)
        out = fs.create(where, True)
        out.write(bytearray(settings.lines().encode()))
        out.close()
        return asdict(settings)
