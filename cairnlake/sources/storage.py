"""Storage settings: where packs lie, as Hadoop URIs."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class StorageConfig:
    backend: str = ""
    path: str = ""
    endpoint: str = ""
    bucket: str = ""
    prefix: str = ""
    access_key: str = ""
    secret_key: str = ""
    use_ssl: bool = True
    object_lock_days: int = 0
    object_lock_compliance: bool = False


def storage_uri(config: StorageConfig) -> str:
    """The URI of a storage; what a backend needs and lacks is an error."""
    if config.backend in ("", "local"):
        return f"file://{config.path.rstrip('/')}/data"
    if config.backend not in ("minio", "s3"):
        raise ValueError(f"unknown storage backend {config.backend!r} (expected 'local' or 'minio')")
    for field in ("endpoint", "bucket"):
        if not getattr(config, field):
            raise ValueError(f"the object storage needs a {field}")
    if not config.access_key or not config.secret_key:
        raise ValueError("the object storage needs an access key and a secret key")
    return "/".join(["s3a:/", config.bucket, *([config.prefix.strip("/")] if config.prefix.strip("/") else [])])


def hadoop_settings(config: StorageConfig) -> dict[str, str]:
    """Settings of the S3 connector for a configuration; none for the local one."""
    if config.backend in ("", "local"):
        return {}
    storage_uri(config)
    return {
        "fs.s3a.endpoint": config.endpoint, "fs.s3a.access.key": config.access_key, "fs.s3a.secret.key": config.secret_key,
        "fs.s3a.connection.ssl.enabled": str(config.use_ssl).lower(), "fs.s3a.path.style.access": "true",
    }


def lock_mode(config: StorageConfig) -> str | None:
    """GOVERNANCE unless COMPLIANCE is asked for; none without a retention."""
    return None if config.object_lock_days <= 0 else "COMPLIANCE" if config.object_lock_compliance else "GOVERNANCE"


def refuse_local_remote(config: StorageConfig) -> None:
    if config.backend in ("", "local"):
        raise ValueError("a replication target can't be local")
