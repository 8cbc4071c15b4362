"""Sequential numpy kernels. Each holds its whole state in plain attributes, so the same object runs a batch group or, pickled, a stream's key."""
