"""Sources: exchange payloads (instruments, funding, REST and stream bars),
zipped CSV archives and bucket listings, parsed with JVM-side expressions."""
