"""Bar operators: resampling, audits, clipping, symbol filters."""
