"""packetloom: packet-flow analytics expressed as Spark DataFrame transforms."""
