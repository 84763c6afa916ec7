"""Part of packetloom."""
