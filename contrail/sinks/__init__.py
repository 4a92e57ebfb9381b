"""Writers: rule outputs, shards, event tables and export feeds."""
