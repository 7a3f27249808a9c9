"""Writers: result tables, versioned state, device series, lines."""
